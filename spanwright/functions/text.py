"""Text to state, and model responses to JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import col

# Openers of a chatty answer, words that carry no state, the shape of an enumeration.
OPENERS = "got it|okay|ok|sure|alright|let'?s|let me|first,?"
STOP_WORDS = ("the", "is", "a", "an", "in", "of", "at", "on", "and", "it", "its")
ENUMERATION = r"[a-z]+\s*/\s*[a-z]+"

# Repairs of malformed JSON, in order.
REPAIRS = (
    (r"(:\s*-?\d+(?:\.\d+)?)s\b", "$1"),
    (r'("confidence"\s*:\s*)"?0\s*-\s*1"?', "$1null"),
    (r"(\d)\s*\](\s*[,}])", "$1$2"),
    (r":\s*<[^>]*>", ": null"),
)

_WHITE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITE))


def clean(text: Column | str) -> Column:
    """What follows the last reasoning block, without conversational openers."""
    answer = strip(F.substring_index(col(text), "</think>", -1))
    return strip(F.regexp_replace(answer, rf"(?i)^(?:\s*(?:{OPENERS})\b[^.]*[.:]\s*)+", ""))


def distinguishing(a: str, b: str) -> list[str]:
    """Words of state a that state b lacks."""
    import re

    words = [w for w in re.findall(r"[a-z]+", a.lower()) if w not in STOP_WORDS]
    others = {w for w in re.findall(r"[a-z]+", b.lower())}
    return [w for w in words if w not in others]


def last_mention(text: Column, words: list[str]) -> Column:
    """Position (from 1) of the last mention of any word as a substring; 0 if none."""
    found = [F.when(F.instr(text, w) > 0, F.length(text) - F.instr(F.reverse(text), w[::-1]) - len(w) + 2).otherwise(0) for w in words]
    if not found:
        return F.lit(0)
    return F.greatest(*found) if len(found) > 1 else found[0]


def parse_state(text: Column | str, state_a: str, state_b: str) -> Column:
    """The state a text asserts: enumerations blanked, the last mention wins, a tie goes to b; null if neither is named."""
    low = F.lower(col(text))
    # A blank of any length keeps the order of mentions.
    low = F.regexp_replace(low, ENUMERATION, " ")
    a, b = last_mention(low, distinguishing(state_a, state_b)), last_mention(low, distinguishing(state_b, state_a))
    return F.when((a == 0) & (b == 0), F.lit(None)).when(a > b, state_a).otherwise(state_b)


def subject(state: Column | str) -> Column:
    """What a state is about: "the door is open" gives "door"."""
    return F.substring_index(F.replace(col(state), F.lit("the "), F.lit("")), " is ", 1)


def split_by_subject(text: Column | str, subjects: list[str]) -> Column:
    """Map from subject to the first line that names it in its head; longer subjects take a line first; "" if none."""
    ordered = sorted(subjects, key=len, reverse=True)
    lines = F.filter(F.transform(F.split(col(text), "\r\n|\n|\r"), strip), lambda x: x != "")
    start = F.array(*[F.lit("") for _ in ordered])

    def step(held: Column, line: Column) -> Column:
        low = F.lower(line)
        taken = F.lit(False)
        out = []
        for k, s in enumerate(ordered):
            head = F.when(F.instr(low, ":") > 0, F.substring_index(low, ":", 1)).otherwise(F.substring(low, 1, len(s) + 2))
            mine = F.contains(head, F.lit(s.lower())) & (F.get(held, k) == "") & ~taken
            out.append(F.when(mine, line).otherwise(F.get(held, k)))
            taken = taken | mine
        return F.array(*out)

    return F.map_from_arrays(F.array(*[F.lit(s) for s in ordered]), F.aggregate(lines, start, step))


def split_reasoning(text: Column | str) -> tuple[Column, Column]:
    """(reasoning, answer). A block that never ends leaves no answer."""
    raw = F.coalesce(col(text), F.lit(""))
    blocks = F.regexp_extract_all(raw, F.lit(r"(?is)(<think>.*?</think>)"), F.lit(1))
    cut_off = (F.size(blocks) == 0) & F.contains(F.lower(raw), F.lit("<think>"))
    answer = strip(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""))
    return F.when(cut_off, raw).otherwise(strip(F.array_join(blocks, "\n"))), F.when(cut_off, "").otherwise(answer)


def repair_patterns(text: Column | str) -> Column:
    out = col(text)
    for pattern, replacement in REPAIRS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def size_band(height: Column | str) -> Column:
    return F.when(col(height) >= 250, "good").when(col(height) >= 120, "marginal").otherwise("too-small")


def motion_verdict(mean_pct: Column | str) -> Column:
    return F.when(col(mean_pct) < 0.5, "static").when(col(mean_pct) > 1.5, "active").otherwise("faint")


def activity_of_stem(stem: Column | str) -> Column:
    return F.regexp_replace(col(stem), "^ex[^-]*-", "")


def seconds_of_name(name: Column | str) -> Column:
    """Length of a recording named HH-MM-SS.HH-MM-SS, over midnight if need be."""
    ends = F.split(col(name), r"\.")
    clock = lambda x: F.get(F.split(x, "-"), 0).cast("int") * 3600 + F.get(F.split(x, "-"), 1).cast("int") * 60 + F.get(F.split(x, "-"), 2).cast("int")
    d = clock(F.get(ends, 1)) - clock(F.get(ends, 0))
    return F.when(d < 0, d + 86_400).otherwise(d)


def query_list(text: Column | str) -> Column:
    """Descriptions of a list with semicolons, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(col(text), ";"), strip), lambda x: x != "")


def two_way_softmax(yes: Column | str, no: Column | str, missing: float = -60.0) -> Column:
    y, n = F.exp(F.coalesce(col(yes), F.lit(missing))), F.exp(F.coalesce(col(no), F.lit(missing)))
    return y / (y + n)


def tile_width(height: Column | str) -> Column:
    return F.coalesce(F.greatest(F.lit(480), F.least(F.lit(1280), F.bround(1920 * 150 / F.nullif(col(height), F.lit(0))).cast("int"))), F.lit(720))


def slug(text: Column | str, most: int = 34) -> Column:
    """The beginning of a description as a part of a file name."""
    return F.replace(F.substring(col(text), 1, most), F.lit(" "), F.lit("-"))


def day_of(name: Column | str) -> Column:
    """Month and day of a recording's dotted name, YYYY-MM-DD first; "" for a name without dots."""
    return F.when(F.contains(col(name), F.lit(".")), F.substring(F.substring_index(col(name), ".", 1), 6, 100)).otherwise("")


def scene_of(name: Column | str) -> Column:
    """Day and camera of a dotted name: of its last three parts, the two before the suffix; a short name's first letters otherwise."""
    parts = F.split(col(name), r"\.")
    return F.when(F.size(parts) >= 3, F.concat_ws("_", day_of(name), F.array_join(F.slice(parts, F.size(parts) - 2, 2), "."))).otherwise(F.substring(col(name), 1, 12))


def clip_tag(name: Column | str) -> Column:
    """Day and the part before the last two of a dotted name."""
    parts = F.split(col(name), r"\.")
    return F.concat_ws("_", day_of(name), F.try_element_at(parts, F.lit(-3)))
