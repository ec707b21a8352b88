"""Quantities recorded in different units, brought to canonical ones.

``to_canonical`` adds the canonical value of a number whose unit stands in a
text column. ``gripper_openings`` applies it to gripper states: lengths, finger
angles and shares of the stroke all become millimetres of opening.

The unit texts are parsed by the grammar of ``kinelake.functions.units`` in an
Arrow function, each distinct text of a batch once; values are scaled by JVM
expressions. Row counts never change and nothing is shuffled: grippers are a
fixed dimension table, and Spark broadcasts it only below its own size limit.

Defined cases: an unknown, null or blank unit text counts as silent, so the
next text decides; where all are silent the unit is null and so is the result.
Null, NaN and infinite values give null. Units of any other dimension (a mass,
a torque) give null. Ties of .5 are rounded away from zero.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.units import DIMENSIONS, Unit, parse_unit, statement_unit

UNIT_TYPE = "struct<dims:array<int>,scale:double,offset:double>"
_MEMO_LIMIT = 50_000


def _row(unit: Unit | None) -> dict | None:
    return None if unit is None else {"dims": list(unit.dims), "scale": float(unit.scale), "offset": float(unit.offset)}


def _parser(read):
    memo: dict[str, dict | None] = {}

    def parse(texts: pd.Series) -> pd.DataFrame:
        if len(memo) > _MEMO_LIMIT:
            memo.clear()
        for t in texts.dropna().unique():
            if t not in memo:
                memo[t] = _row(read(t))
        rows = [memo.get(t) if isinstance(t, str) else None for t in texts]
        none = {"dims": None, "scale": None, "offset": None}
        return pd.DataFrame([r or none for r in rows], columns=["dims", "scale", "offset"])

    return parse


def unit_of_label(text: Column) -> Column:
    """Struct (dims, scale, offset) of a unit label; its fields are null if the label says nothing."""

    @F.pandas_udf(UNIT_TYPE)
    def label_unit(t: pd.Series) -> pd.DataFrame:
        return _label(t)

    return label_unit(text)


def unit_of_remark(text: Column) -> Column:
    """Struct (dims, scale, offset) of the unit that a remark states for the gripper's own value."""

    @F.pandas_udf(UNIT_TYPE)
    def remark_unit(t: pd.Series) -> pd.DataFrame:
        return _remark(t)

    return remark_unit(text)


_label = _parser(parse_unit)
_remark = _parser(statement_unit)


def to_canonical(df: DataFrame, value: str, unit_text: str, prefix: str = "canonical") -> DataFrame:
    """Adds {prefix}_value and {prefix}_dims: value * scale + offset in the canonical unit of its dimension."""
    u = F.col(f"__{prefix}_unit")
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return (
        df.withColumn(f"__{prefix}_unit", unit_of_label(F.col(unit_text)))
        .withColumn(f"{prefix}_value", F.when(finite, F.col(value).cast("double") * u["scale"] + u["offset"]))
        .withColumn(f"{prefix}_dims", u["dims"])
        .drop(f"__{prefix}_unit")
    )


def _is(dims: Column, **powers: int) -> Column:
    return dims == F.array(*[F.lit(powers.get(d, 0)) for d in DIMENSIONS])


NO_READING = 65535  # fixed value: the integer columns' "no reading"


def gripper_openings(states: DataFrame, grippers: DataFrame) -> DataFrame:
    """(hand_id, raw_value, unit_from, dims, scale, opening, opening_mm, in_millimetres) of every hand state.

    opening is the exact value in millimetres, opening_mm the whole one;
    unit_from is label, remark or note. Where the value says nothing (null,
    65535, NaN, infinite) or no unit can be told, the openings are null.
    """
    notes = grippers.select(
        F.col("robot_id").alias("g_robot"),
        F.col("joint_name").alias("g_joint"),
        "stroke_mm",
        "open_angle_rad",
        unit_of_remark(F.col("unit_note")).alias("note_unit"),
    ).dropDuplicates(["g_robot", "g_joint"])
    s = states.select("hand_id", "robot_id", "joint_name", "hand_kind", "agi_pos", "claw_position", "joint_position", "unit_label", "remark")
    integer = lambda c: F.when(F.col(c) != NO_READING, F.col(c).cast("double"))
    real = F.when(~F.isnan("joint_position") & (F.abs("joint_position") < F.lit(float("inf"))), F.col("joint_position"))
    raw = F.when(F.col("hand_kind") == "agi_claw_state", integer("agi_pos")).when(F.col("hand_kind") == "claw", integer("claw_position")).when(F.col("hand_kind") == "joint", real)
    s = s.withColumn("raw_value", raw).withColumn("label_unit", unit_of_label("unit_label")).withColumn("remark_unit", unit_of_remark("remark"))
    s = s.join(notes, (s["robot_id"] == notes["g_robot"]) & (s["joint_name"] == notes["g_joint"]), "left")
    has = lambda c: F.col(f"{c}.scale").isNotNull()
    unit = F.when(has("label_unit"), F.col("label_unit")).when(has("remark_unit"), F.col("remark_unit")).when(has("note_unit"), F.col("note_unit"))
    said = F.when(has("label_unit"), "label").when(has("remark_unit"), "remark").when(has("note_unit"), "note")
    s = s.select("hand_id", "raw_value", "stroke_mm", "open_angle_rad", said.alias("unit_from"), unit.alias("u")).withColumns({"dims": F.col("u.dims"), "scale": F.col("u.scale")})
    canonical = F.col("raw_value") * F.col("scale") + F.col("u.offset")
    length, angle, share = _is(F.col("dims"), length=1), _is(F.col("dims"), angle=1), _is(F.col("dims"))
    opening = F.when(length, canonical * 1000).when(angle, canonical / F.col("open_angle_rad") * F.col("stroke_mm")).when(share, canonical * F.col("stroke_mm"))
    return s.select(
        "hand_id",
        "raw_value",
        "unit_from",
        "dims",
        "scale",
        opening.alias("opening"),
        # ten decimals first: 0.745 * 100 must count as the half that it is
        F.round(F.round(opening, 9), 0).cast("long").alias("opening_mm"),
        F.coalesce(length & (F.abs(F.col("scale") - 0.001) < 1e-12), F.lit(False)).alias("in_millimetres"),
    )
