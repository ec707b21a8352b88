"""A grammar for unit expressions.

A unit is a vector of dimension exponents with a scale and an offset to the
canonical unit of that dimension: canonical = value * scale + offset.

    statement := quotient
    quotient  := product (('/' | 'per') product)*
    product   := factor (('*' | '·' | '×') factor)*  |  'N' 'm'
    factor    := number? atom power?  |  number '/' number atom  |  fraction-word 'of' 'a'? atom  |  range
    range     := number ('..' | '-' | 'to') number   (a share of the span)
    power     := '^' '-'? integer  |  raised digits

Numbers may stand before an atom ("0.1 mm", "1/10 mm"). "counts of 255",
"cnt/255" and "full scale 255" are shares too. Prefixes are read where the
atom takes them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from fractions import Fraction

#: Base dimensions, in the order of the exponent vector.
DIMENSIONS = ("length", "mass", "time", "current", "temperature", "amount", "luminosity", "angle")
NONE = (0,) * len(DIMENSIONS)


def _dim(**powers: int) -> tuple[int, ...]:
    return tuple(powers.get(d, 0) for d in DIMENSIONS)


@dataclass(frozen=True)
class Unit:
    """Dimension exponents, and scale and offset to the canonical unit (metre, kilogram, second, ..., radian, share)."""

    dims: tuple[int, ...]
    scale: float
    offset: float = 0.0

    def times(self, other: Unit, power: int = 1) -> Unit:
        return Unit(tuple(a + power * b for a, b in zip(self.dims, other.dims)), self.scale * other.scale**power)

    def canonical(self, value: float) -> float:
        return value * self.scale + self.offset


# Symbols and names of units, with dimension, scale and offset to the canonical unit.
LENGTH, ANGLE, TIME, MASS = _dim(length=1), _dim(angle=1), _dim(time=1), _dim(mass=1)
FORCE, ENERGY = _dim(mass=1, length=1, time=-2), _dim(mass=1, length=2, time=-2)
PLAIN_ATOMS: dict[str, Unit] = {
    "in": Unit(LENGTH, 0.0254), "inch": Unit(LENGTH, 0.0254), "inches": Unit(LENGTH, 0.0254), '"': Unit(LENGTH, 0.0254),
    "ft": Unit(LENGTH, 0.3048), "foot": Unit(LENGTH, 0.3048), "feet": Unit(LENGTH, 0.3048),
    "yd": Unit(LENGTH, 0.9144), "mil": Unit(LENGTH, 0.0000254), "mils": Unit(LENGTH, 0.0000254), "thou": Unit(LENGTH, 0.0000254),
    "micron": Unit(LENGTH, 1e-6), "microns": Unit(LENGTH, 1e-6),
    "deg": Unit(ANGLE, math.pi / 180), "degs": Unit(ANGLE, math.pi / 180), "degree": Unit(ANGLE, math.pi / 180), "degrees": Unit(ANGLE, math.pi / 180), "°": Unit(ANGLE, math.pi / 180),
    "arcmin": Unit(ANGLE, math.pi / 10800), "rev": Unit(ANGLE, 2 * math.pi), "turn": Unit(ANGLE, 2 * math.pi), "turns": Unit(ANGLE, 2 * math.pi), "grad": Unit(ANGLE, math.pi / 200), "gon": Unit(ANGLE, math.pi / 200),
    "min": Unit(TIME, 60), "minute": Unit(TIME, 60), "minutes": Unit(TIME, 60), "h": Unit(TIME, 3600), "hour": Unit(TIME, 3600), "hours": Unit(TIME, 3600),
    "rpm": Unit(_dim(angle=1, time=-1), math.pi / 30),
    "lb": Unit(MASS, 0.45359237), "lbs": Unit(MASS, 0.45359237), "oz": Unit(MASS, 0.028349523125),
    "lbf": Unit(FORCE, 4.4482216152605), "kgf": Unit(FORCE, 9.80665),
    "degc": Unit(_dim(temperature=1), 1, 273.15), "°c": Unit(_dim(temperature=1), 1, 273.15), "celsius": Unit(_dim(temperature=1), 1, 273.15),
    "degf": Unit(_dim(temperature=1), 5 / 9, 459.67 * 5 / 9), "°f": Unit(_dim(temperature=1), 5 / 9, 459.67 * 5 / 9), "fahrenheit": Unit(_dim(temperature=1), 5 / 9, 459.67 * 5 / 9),
    "%": Unit(NONE, 1e-2), "percent": Unit(NONE, 1e-2), "pct": Unit(NONE, 1e-2), "percentage": Unit(NONE, 1e-2),
    "‰": Unit(NONE, 1e-3), "permille": Unit(NONE, 1e-3), "permil": Unit(NONE, 1e-3), "promille": Unit(NONE, 1e-3), "thousandths": Unit(NONE, 1e-3), "hundredths": Unit(NONE, 1e-2), "ppm": Unit(NONE, 1e-6),
    "fraction": Unit(NONE, 1), "ratio": Unit(NONE, 1), "share": Unit(NONE, 1), "normalised": Unit(NONE, 1), "normalized": Unit(NONE, 1),
}
PREFIXED_ATOMS: dict[str, Unit] = {
    "m": Unit(LENGTH, 1), "s": Unit(TIME, 1), "g": Unit(MASS, 1e-3), "rad": Unit(ANGLE, 1), "N": Unit(FORCE, 1), "Nm": Unit(ENERGY, 1), "J": Unit(ENERGY, 1), "Hz": Unit(_dim(time=-1), 1),
    "A": Unit(_dim(current=1), 1), "K": Unit(_dim(temperature=1), 1), "mol": Unit(_dim(amount=1), 1), "cd": Unit(_dim(luminosity=1), 1), "W": Unit(_dim(mass=1, length=2, time=-3), 1), "Pa": Unit(_dim(mass=1, length=-1, time=-2), 1),
    "V": Unit(_dim(mass=1, length=2, time=-3, current=-1), 1), "L": Unit(_dim(length=3), 1e-3), "t": Unit(MASS, 1e3),
}
LONG_ATOMS: dict[str, Unit] = {
    "metre": Unit(LENGTH, 1), "meter": Unit(LENGTH, 1), "second": Unit(TIME, 1), "sec": Unit(TIME, 1), "gram": Unit(MASS, 1e-3), "radian": Unit(ANGLE, 1), "newton": Unit(FORCE, 1), "joule": Unit(ENERGY, 1), "kelvin": Unit(_dim(temperature=1), 1), "ampere": Unit(_dim(current=1), 1),
}
SHORT_PREFIX = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "da": 1e1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
LONG_PREFIX = {"pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "deci": 1e-1, "deca": 1e1, "hecto": 1e2, "kilo": 1e3, "mega": 1e6, "giga": 1e9, "tera": 1e12}
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
FRACTION_WORDS = {"tenth": 0.1, "tenths": 0.1, "hundredth": 0.01, "hundredths": 0.01, "thousandth": 0.001, "thousandths": 0.001, "half": 0.5, "quarter": 0.25, "quarters": 0.25}
COUNT_WORDS = {"count", "counts", "cnt", "cnts", "ticks", "lsb"}


#: Symbols with all prefixes as they are spelled, and again in lower case: a spelling that two symbols share then goes to the smaller prefix.
SYMBOLS: dict[str, Unit] = {}
FOLDED: dict[str, Unit] = {}


def _spell() -> None:
    for short, unit in PREFIXED_ATOMS.items():
        SYMBOLS.setdefault(short, unit)
        for prefix, scale in SHORT_PREFIX.items():
            SYMBOLS.setdefault(prefix + short, Unit(unit.dims, unit.scale * scale))
    for name in sorted(SYMBOLS, key=lambda n: (n != n.lower(), n in ("t", "T"), SYMBOLS[n].scale)):
        FOLDED.setdefault(name.lower(), SYMBOLS[name])


_spell()


def atom(word: str) -> Unit | None:
    """The unit that a symbol or a name stands for.

    A symbol is read in its exact case first (MPa, mPa, Nm, nm), names and
    symbols in any other case after that (MM, INCH).
    """
    w = word.lower()
    if word in SYMBOLS and w not in PLAIN_ATOMS:
        return SYMBOLS[word]
    if w in PLAIN_ATOMS:
        return PLAIN_ATOMS[w]
    if w in FOLDED:
        return FOLDED[w]
    for long, unit in LONG_ATOMS.items():
        head = next((h for h in (w[: -len(long)] if w.endswith(long) else None, w[: -len(long) - 1] if w.endswith(long + "s") else None) if h is not None), None)
        if head is not None:
            head = head.rstrip("-_ ")
            if not head:
                return unit
            if head in LONG_PREFIX:
                return Unit(unit.dims, unit.scale * LONG_PREFIX[head])
    return None


TOKEN = re.compile(r"\d+(?:\.\d+)?(?:e[+-]?\d+)?|\.\.+|[a-zµμ]+(?:-[a-zµμ]+)*|°[cf]?(?![a-z])|%|‰|[/*·×⋅^\[\]()=\"–+.,;:_-]", re.I)
POWERS = re.compile("(?<=[A-Za-zµμΩ])([⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)")


def tokens(text: str) -> list[str]:
    """Tokens of a text as spelled, width forms folded, raised digits as powers; blanks are dropped."""
    raised = POWERS.sub(lambda m: "^" + m[1].translate(SUPERSCRIPTS), text)
    return TOKEN.findall(unicodedata.normalize("NFKC", raised))


def _number(token: str | None) -> float | None:
    try:
        return float(token) if token and token[0].isdigit() else None
    except ValueError:
        return None


class _Parser:
    """Recursive descent over a token list, from a position; ``at`` is behind what was read."""

    def __init__(self, toks: list[str], at: int = 0) -> None:
        self.toks, self.at = toks, at

    def peek(self, k: int = 0) -> str | None:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else None

    def word(self, k: int = 0) -> str:
        return (self.peek(k) or "").lower()

    def take(self, *words: str) -> bool:
        if self.word() in words and self.peek():
            self.at += 1
            return True
        return False

    def quotient(self) -> Unit | None:
        unit = self.product()
        while unit is not None:
            mark = self.at
            if not self.take("/", "per"):
                return unit
            n = _number(self.peek())
            if n and unit.dims == NONE:
                self.at += 1
                unit = Unit(NONE, unit.scale / n)
                continue
            below = self.product()
            if below is None:
                self.at = mark
                return unit
            unit = unit.times(below, -1)
        return None

    def product(self) -> Unit | None:
        unit = self.factor()
        while unit is not None:
            mark = self.at
            more = self.factor() if self.take("*", "·", "×", "⋅") else self.neighbour()
            if more is None:
                self.at = mark
                return unit
            unit = unit.times(more)
        return None

    def neighbour(self) -> Unit | None:
        """A second symbol of a product written side by side: 'N m'. Both must be symbols of their own dimension."""
        before = SYMBOLS.get(self.toks[self.at - 1])
        after = SYMBOLS.get(self.peek() or "")
        if before is None or after is None or before.dims == after.dims or len(self.toks[self.at - 1]) > 2 or self.toks[self.at - 1] not in ("N", "kN", "mN", "A", "W", "kW"):
            return None
        return self.powered()

    def factor(self) -> Unit | None:
        mark = self.at
        for rule in (self.span, self.scaled, self.worded, self.counted, self.powered):
            unit = rule()
            if unit is not None:
                return unit
            self.at = mark
        return None

    def span(self) -> Unit | None:
        """'0-255', '0..1', '0 to 100 percent': a share of the span."""
        low = _number(self.peek())
        if low is None:
            return None
        self.at += 1
        if not self.take("-", "–", "to") and not (self.peek() or "").startswith(".."):
            return None
        if (self.peek() or "").startswith(".."):
            self.at += 1
        high = _number(self.peek())
        if high is None or high <= low or low != 0:
            return None
        self.at += 1
        mark = self.at
        unit = self.powered()
        if unit is not None and unit.dims == NONE:
            return unit if abs(unit.scale * high - 1) < 1e-9 else None
        self.at = mark
        return Unit(NONE, 1 / high)

    def scaled(self) -> Unit | None:
        n = _number(self.peek())
        if n is None:
            return None
        self.at += 1
        if self.peek() == "/" and _number(self.peek(1)):
            n /= _number(self.peek(1))
            self.at += 2
        self.take("-")
        unit = self.powered()
        return Unit(unit.dims, unit.scale * n) if unit is not None and n else None

    def worded(self) -> Unit | None:
        """'tenths of a millimetre'."""
        part = FRACTION_WORDS.get(self.word())
        if part is None:
            return None
        self.at += 1
        if not self.take("of"):
            return None
        self.take("a", "an", "one")
        unit = self.powered()
        return Unit(unit.dims, unit.scale * part) if unit is not None and unit.dims != NONE else None

    def counted(self) -> Unit | None:
        """'counts of 255', 'cnt/255', 'full scale 255', '255 = full stroke', '8-bit': a share."""
        if self.take("full", "full-scale"):
            self.take("scale")
            self.take("=", "of")
        elif self.word() in COUNT_WORDS:
            self.at += 1
            self.take(",")
            self.take("full")
            self.take("scale")
            if not self.take("of", "/", "="):
                if self.toks[self.at - 1].lower() != "scale":
                    return None
        n = _number(self.peek())
        if n is None or n <= 0:
            return None
        after = atom(self.peek(1) or "")
        if after is not None and after.dims != NONE:
            return None  # steps of a size, no share
        behind = self.toks[max(0, self.at - 1)].lower() if self.at else ""
        self.at += 1
        if behind in ("of", "/", "=", "scale"):
            return Unit(NONE, 1 / n)
        if self.take("="):
            return Unit(NONE, 1 / n) if self.take("full", "open") else None
        if self.take("-"):
            return Unit(NONE, 1 / (2**n - 1)) if self.take("bit", "bits") else None
        return Unit(NONE, 1 / (2**n - 1)) if self.take("bit", "bits") else None

    def powered(self) -> Unit | None:
        if self.take("per"):
            return Unit(NONE, 1e-2) if self.take("cent") else Unit(NONE, 1e-3) if self.take("mille", "mil") else None
        unit = atom(self.peek() or "")
        if unit is None and self.peek() and self.peek(1) in ("-", "_"):
            unit = atom(self.peek() + (self.peek(2) or ""))
            self.at += 2 if unit is not None else 0
        if unit is None:
            return None
        self.at += 1
        power = 1
        if self.take("^"):
            sign = -1 if self.take("-") else 1
            n = _number(self.peek())
            if n is None:
                return None
            self.at += 1
            power = sign * int(n)
        if power == 1:
            return unit
        return Unit(tuple(power * d for d in unit.dims), unit.scale**power)


def parse_unit(text: str | None) -> Unit | None:
    """The unit that the whole text spells, or None (null, blank, anything else)."""
    if text is None:
        return None
    toks = [t for t in tokens(text) if t not in "[]()"]
    while toks and toks[-1] in (".", ",", ";", ":"):
        toks.pop()
    if not toks:
        return None
    p = _Parser(toks)
    unit = p.quotient()
    return unit if unit is not None and p.at == len(toks) else None


def parse_quantity(text: str | None) -> tuple[float, Unit] | None:
    """(canonical value, unit) of a text such as '12.5 cm' or '-3 N*m'; None if it is no number with a unit."""
    m = re.match(r"\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?)\s*(.*)$", text or "", re.I | re.S)
    if not m or not m[2].strip():
        return None
    unit = parse_unit(m[2])
    return (unit.canonical(float(Fraction(m[1]) if "e" not in m[1].lower() else float(m[1]))), unit) if unit else None


# Words that name the gripper's own value, and words after which a unit is only a preposition's object.
SUBJECT_WORDS = {"jaw", "jaws", "opening", "gripper", "claw", "finger", "link", "stroke", "encoder", "counts", "count", "gap", "aperture"}
STEP_WORDS = {"step", "steps", "=", "of", "count", "counts", "unit", "units", "in", "is", "tick", "ticks", "per", "by", "(", "each"}
LONE = {"a", "k", "h", "s", "t", "l", "v", "w"}  # single letters that are words or names more often than units
FILLER = {"of", "the", "a", "an", "full", "one", "step", "steps", "=", "scale", "over", "is", "logged", "as", "value", "raw", "in", "between"}


def statement_unit(text: str | None) -> Unit | None:
    """The unit that a free remark states for the gripper's own value, or None.

    A remark consists of clauses. One that names the gripper's value (jaw,
    opening, finger angle, encoder counts, ...) states the unit, in itself or in
    the clause that goes on with it. A number directly before a length or an
    angle makes it a measurement (an object 12 cm wide, a door open 0.9 m), not
    a unit, unless the words before it make it the size of a step.
    """
    if not text or not text.strip():
        return None
    clauses = [tokens(c) for c in re.split(r";|,|\.\s|\.$|:\s|\s-\s", unicodedata.normalize("NFKC", text))]
    clauses = [[t for t in c if t not in "[]()"] for c in clauses if c]
    for i, clause in enumerate(clauses):
        if not SUBJECT_WORDS & {w for t in clause for w in (t.lower(), *t.lower().split("-"))}:
            continue
        found = _scan(clause)
        if found is None and i + 1 < len(clauses):
            found = _scan(clauses[i + 1], lead=True)
        if found is not None:
            return found
    return None


def _stepped(before: list[str]) -> bool:
    """Whether the words before a quantity make it the size of a step: 'one step = 0.1 mm', 'counts of 0.1 mm', 'in 0.1 mm'."""
    return bool(before) and before[-1].lower() in STEP_WORDS


def _scan(clause: list[str], lead: bool = False) -> Unit | None:
    """The unit stated within a clause. lead: it must stand at the clause's beginning, but for fillers."""
    best: Unit | None = None
    longest = 0
    for at in range(len(clause)):
        if lead and any(t.lower() not in FILLER for t in clause[:at]):
            break
        if clause[at].lower() in LONE and (at + 1 == len(clause) or clause[at + 1] not in ("/", "*", "·", "^")):
            continue
        if at and _number(clause[at - 1]) is not None and not (at > 1 and clause[at - 2] == "/"):
            continue  # the number belongs to it
        p = _Parser(clause, at)
        unit = p.quotient()
        if unit is None or (unit.dims == NONE and clause[at].lower() == "full" and p.at - at < 2):
            continue
        if clause[at].lower() == "in" and p.at == at + 1 and at + 1 < len(clause):
            continue  # the preposition
        if _number(clause[at]) is not None and unit.dims != NONE and not _stepped(clause[:at]):
            continue  # a measurement: "12 cm wide"
        if p.at - at > longest:
            best, longest = unit, p.at - at
    return best
