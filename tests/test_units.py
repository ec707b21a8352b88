import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinelake.functions.units import parse_quantity, parse_unit, statement_unit
from kinelake.operators.units import gripper_openings, to_canonical

L, A, S = (1, 0), (0, 1), (0, 0)


def short(u):
    return None if u is None else ((u.dims[0], u.dims[7]), round(u.scale, 12))


@pytest.mark.parametrize(
    "text, dims, scale",
    [("mm", L, 1e-3), (" MM ", L, 1e-3), ("milli-meters", L, 1e-3), ("0.1mm", L, 1e-4), ("1/10 mm", L, 1e-4), ("tenths of a millimetre", L, 1e-4), ("inches", L, 0.0254), ("in", L, 0.0254),
     ("mrad", A, 1e-3), ("°", A, math.pi / 180), ("0-255", S, 1 / 255), ("0..1", S, 1), ("0 to 100 percent", S, 1e-2), ("counts of 255", S, 1 / 255), ("cnt/255", S, 1 / 255), ("per mille", S, 1e-3), ("‰", S, 1e-3)],
)
def test_labels(text, dims, scale):
    assert short(parse_unit(text)) == (dims, round(scale, 12))


def test_compound_units_and_offsets():
    torque, speed = parse_unit("N*m"), parse_unit("km/h")
    assert torque.dims[:3] == (2, 1, -2) and speed.dims[:3] == (1, 0, -1) and speed.scale == pytest.approx(1 / 3.6)
    assert parse_unit("m/s^2").dims[:3] == (1, 0, -2)
    assert parse_quantity("25 degC")[0] == pytest.approx(298.15)
    assert parse_quantity("-1.5e2 mm")[0] == pytest.approx(-0.15)


@pytest.mark.parametrize("text", [None, "", "  ", "bananas", "12", "mm mm", "0-0", "/"])
def test_what_is_no_unit(text):
    assert parse_unit(text) is None


@given(st.text(max_size=40))
def test_any_text_is_survived(text):
    parse_unit(text), statement_unit(text), parse_quantity(text)


@pytest.mark.parametrize(
    "remark, want",
    [("object about 12 cm wide", None), ("door open 0.9 m", None), ("battery at 80 percent", None), ("fingers cleaned before the run", None), (None, None), ("", None),
     ("second try, 4 in from the table edge", None), ("jaw gap in m", (L, 1)), ("jaw gap in inch, US pendant", (L, 0.0254)), ("run 3: JAW GAP, % OF FULL STROKE", (S, 0.01)),
     ("tray 300 mm away; jaw value 0-1000, thousandths of the stroke", (S, 1e-3)), ("object about 5 cm wide; raw encoder counts, 255 = full stroke", (S, round(1 / 255, 12))),
     ("8-bit jaw value, 0 to 255 over the stroke, door open 1 m", (S, round(1 / 255, 12))), ("Unit of the jaw value: CM.", (L, 0.01)), ("jaw gap, one step = 0.1 mm, light changed", (L, 1e-4))],
)
def test_remarks(remark, want):
    assert short(statement_unit(remark)) == want


STATES = "hand_id long, robot_id string, episode_id string, joint_name string, hand_kind string, agi_pos long, claw_position long, joint_position double, unit_label string, remark string, stroke_mm string"
GRIPPERS = "robot_id string, joint_name string, hand_kind string, stroke_mm double, open_angle_rad double, unit_note string"


def test_openings_by_hand(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "r", "e", "g", "claw", None, 745, None, "‰", "jaw gap, mm", "x"),  # the label wins; .5 goes up
        (2, "r", "e", "g", "claw", None, 10, None, " ", "jaw gap in cm", "x"),  # then the remark
        (3, "r", "e", "g", "agi_claw_state", 50, 9, 9.0, None, "light changed", "x"),  # then the note
        (4, "r", "e", "g", "joint", None, None, 0.5, "rad", None, "x"),
        (5, "r", "e", "g", "claw", None, 65535, None, "mm", None, "x"),
        (6, "r", "e", "g", "joint", None, None, nan, "rad", None, "x"),
        (7, "r", "e", "g", "joint", None, None, inf, "rad", None, "x"),
        (8, "r", "e", "g", "claw", None, 33, None, "mm", None, "x"),
        (9, "other", "e", "g", "claw", None, 3, None, None, None, "x"),  # no gripper, no unit
        (10, "r", "e", "g", None, 1, 1, 1.0, "mm", None, "x"),
        (11, "r", "e", "g", "claw", None, 2, None, "kg", None, "x"),
    ]
    g = [("r", "g", "claw", 100.0, 1.0, "opening in percent of the stroke")]
    out = {r["hand_id"]: (r["opening_mm"], r["unit_from"], r["in_millimetres"]) for r in gripper_openings(spark.createDataFrame(rows, STATES), spark.createDataFrame(g, GRIPPERS)).collect()}
    assert out == {1: (75, "label", False), 2: (100, "remark", False), 3: (50, "note", False), 4: (50, "label", False), 5: (None, "label", True), 6: (None, "label", False), 7: (None, "label", False), 8: (33, "label", True), 9: (None, None, False), 10: (None, "label", True), 11: (None, "label", False)}
    assert gripper_openings(spark.createDataFrame([], STATES), spark.createDataFrame(g, GRIPPERS)).count() == 0


def test_any_quantity(spark):
    df = spark.createDataFrame([(25.0, "degC"), (1.0, "ft"), (2.0, None), (None, "m"), (float("nan"), "m")], "v double, u string")
    assert [round(r["canonical_value"], 6) if r["canonical_value"] is not None else None for r in to_canonical(df, "v", "u").collect()] == [298.15, 0.3048, None, None, None]


@pytest.mark.parametrize(
    "text, dims, scale",
    [("MPa", (-1, 1, -2), 1e6), ("mPa", (-1, 1, -2), 1e-3), ("kPa", (-1, 1, -2), 1e3), ("MHz", (0, 0, -1), 1e6), ("mHz", (0, 0, -1), 1e-3), ("Nm", (2, 1, -2), 1.0), ("N m", (2, 1, -2), 1.0), ("nm", (1, 0, 0), 1e-9), ("N·m", (2, 1, -2), 1.0),
     ("m/s²", (1, 0, -2), 1.0), ("m s⁻²", None, None), ("m³", (3, 0, 0), 1.0), ("s⁻¹", (0, 0, -1), 1.0), ("MM", (1, 0, 0), 1e-3), ("CM", (1, 0, 0), 1e-2), ("GW", (2, 1, -3), 1e9), ("megahertz", None, None), ("kilonewtons", (1, 1, -2), 1e3)],
)
def test_symbols_in_their_case(text, dims, scale):
    u = parse_unit(text)
    assert (u is None and dims is None) or (u.dims[:3] == dims and u.scale == pytest.approx(scale))


@pytest.mark.parametrize("remark", ["jaw opened while object 12 cm wide", "gripper 3 m from the door", "jaw value seen from 40 mm away"])
def test_quantities_are_no_units(remark):
    assert statement_unit(remark) is None


@pytest.mark.parametrize("remark, want", [("gripper moved 3 m away, value in mm", (L, 1e-3)), ("jaw value in mm, object 12 cm wide", (L, 1e-3)), ("jaw gap counts of 0.1 mm", (L, 1e-4)), ("gripper value in MM", (L, 1e-3))])
def test_units_beside_quantities(remark, want):
    assert short(statement_unit(remark)) == want
