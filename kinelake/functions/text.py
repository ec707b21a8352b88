"""Text functions as JVM expressions: answers, prompts, tags, templates, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_answer(c: Column) -> Column:
    """Line ends and tabs to spaces, punctuation dropped or spaced, quotes and brackets stripped, lower case.

    A period between digits stays, every other one goes.
    """
    t = F.translate(c, "\n\t", "  ")
    t = F.regexp_replace(t, r"(?<!\d)\.|\.(?!\d)", "")
    t = F.regexp_replace(t, r"[;/\[\]\"{}()=+\\_\-><@`,?!]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"^['\"(]+|['\")]+$", ""), r" +", " ")
    return F.lower(F.trim(t))


def choice_letter(c: Column) -> Column:
    """The last single letter a to h among the parts between colons; null if there is none."""
    parts = F.filter(F.transform(F.split(F.lower(c), ":"), lambda p: F.trim(p)), lambda p: p.rlike("^[a-h]$"))
    return F.try_element_at(parts, F.lit(-1))


def first_json(c: Column) -> Column:
    """The text from the first brace to the last one, or from the first bracket; null if it isn't JSON."""
    found = F.regexp_extract(c, r"(\{[\s\S]*\})", 1)
    found = F.when(found == "", F.regexp_extract(c, r"(\[[\s\S]*\])", 1)).otherwise(found)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def section(c: Column, name: str) -> Column:
    """What a line 'NAME: value' says; null if there is no such line."""
    v = F.regexp_extract(c, rf"(?m)^\s*{name}\s*:\s*(.*?)\s*$", 1)
    return F.when(v != "", v)


def section_score(c: Column) -> Column:
    """SCORE within 0..1; where it is 0 or missing, satisfied over total, counted from [TRUE] and [FALSE] if not given."""
    said = section(c, "SCORE").try_cast("double")
    true = F.regexp_count(c, F.lit(r"(?i)\[TRUE\]"))
    false = F.regexp_count(c, F.lit(r"(?i)\[FALSE\]"))
    satisfied = F.coalesce(section(c, "SATISFIED_COUNT").try_cast("double"), true.cast("double"))
    total = F.coalesce(section(c, "TOTAL_COUNT").try_cast("double"), (true + false).cast("double"))
    derived = F.coalesce(F.try_divide(satisfied, total), F.lit(0.0))
    return F.greatest(F.least(F.when(F.coalesce(said, F.lit(0.0)) != 0, said).otherwise(derived), F.lit(1.0)), F.lit(0.0))


#: Action codes and their arrows.
ARROWS = {0: "STOP", 1: "↑", 2: "←", 3: "→"}


def action_text(codes: Column) -> Column:
    """Action codes as one string of arrows."""
    names = F.create_map(*[x for k, v in ARROWS.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(codes, lambda k: F.coalesce(F.try_element_at(names, k), F.lit(""))), "")


def parse_actions(text: Column) -> Column:
    """The action codes in a string of arrows, in order."""
    found = F.regexp_extract_all(text, F.lit("(STOP|↑|←|→)"), F.lit(1))
    codes = F.create_map(*[x for k, v in ARROWS.items() for x in (F.lit(v), F.lit(k))])
    return F.transform(found, lambda a: F.element_at(codes, a))


def move_tag_first(text: Column, tag: str = "<image>") -> Column:
    """A text with exactly one tag gets it in front, on its own line; others stay."""
    once = F.regexp_count(text, F.lit(tag)) == 1
    return F.when(once, F.concat(F.lit(tag + "\n"), F.trim(F.replace(text, F.lit(tag), F.lit(""))))).otherwise(text)


def length_estimate(text: Column, images: Column | int = 0, per_image: int = 128) -> Column:
    """Words plus a constant an image; 0 words for empty and null texts."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return words + (images if isinstance(images, Column) else F.lit(images)) * per_image


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def splice_images(text: Column, tag: str, token: int) -> Column:
    """Word counts of the parts between tags, with the image's token between them."""
    parts = F.split(text, tag)
    counts = F.transform(parts, lambda p: F.array(F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))))
    return F.flatten(F.transform(counts, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.array(F.lit(token)), c))))


def bind(value: Column, body) -> Column:
    """body(value) with the value worked out once, where a lambda would repeat it for every element."""
    return F.transform(F.array(value), body)[0]


def mask_before(tokens: Column, template: list[int], ignore: int = -100) -> Column:
    """Labels of a completion: everything up to and including the last occurrence of the template is ignored; all of it if it never occurs."""
    n = len(template)
    want = F.array(*[F.lit(t) for t in template])

    def ends(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.slice(t, i, n) == want)
        return F.struct(t.alias("t"), F.coalesce(F.try_element_at(starts, F.lit(-1)) + n - 1, F.size(t)).alias("end"))

    return bind(bind(tokens, ends), lambda s: F.transform(s["t"], lambda t, i: F.when(i < s["end"], F.lit(ignore)).otherwise(t)))


def pad(tokens: Column, length: int, value: int) -> Column:
    """To a length, by values at the end; longer arrays are cut."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(tokens), F.lit(0)))), 1, length)


#: Separator styles of conversation prompts: (between turns, behind the last one's role).
STYLES = {"single": ("###", ": "), "two": (" ", ": "), "plain": ("\n", "")}


def conversation_prompt(turns: Column, style: str, system: str, seps: tuple[str, str] = (" ", "</s>")) -> Column:
    """A prompt of ordered turns (structs of role and text). Styles two and plain take the separators in turn; an empty text leaves the role open."""
    if style == "single":
        body = F.transform(turns, lambda t: F.when(F.coalesce(t["text"], F.lit("")) != "", F.concat(t["role"], F.lit(": "), t["text"], F.lit("###"))).otherwise(F.concat(t["role"], F.lit(":"))))
        return F.concat(F.lit(system + "###"), F.array_join(body, ""))
    sep = lambda i: F.when(i % 2 == 0, F.lit(seps[0])).otherwise(F.lit(seps[1]))
    if style == "two":
        body = F.transform(turns, lambda t, i: F.when(F.coalesce(t["text"], F.lit("")) != "", F.concat(t["role"], F.lit(": "), t["text"], sep(i))).otherwise(F.concat(t["role"], F.lit(":"))))
        return F.concat(F.lit(system + seps[0]), F.array_join(body, ""))
    body = F.transform(turns, lambda t, i: F.when(F.coalesce(t["text"], F.lit("")) != "", F.concat(t["text"], sep(i))).otherwise(F.lit("")))
    return F.concat(F.lit(system), F.array_join(body, ""))
