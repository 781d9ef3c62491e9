"""Text normalisation and string similarity.

Columns of built-in functions where Spark has them; Arrow UDFs where it lacks them (Unicode normal forms, script names,
Jaro-Winkler, token set ratio, BLAKE2).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

# The nine scripts whose combining marks are kept, as inclusive ranges of code points.
INDIC_RANGES = ((0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF), (0x0D00, 0x0D7F))

# Legal forms and what they are written out as.
LEGAL_FORMS = {
    "ltd": "limited", "pvt": "private", "co": "company", "llp": "llp", "limited": "limited", "private": "private", "company": "company",
    "llc": "llc", "inc": "incorporated", "corp": "corporation", "pc": "pc", "l": "l", "p": "p", "corporation": "corporation", "incorporated": "incorporated",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sci": "sci", "sa": "sa", "societe": "societe",
}

_DROPPED = regex.compile(r"[\p{P}\p{S}\p{C}]+")
_INDIC_RUN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INDIC_RANGES) + "]+")


def _bare(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))


def clean(text: str | None) -> str:
    """NFKC, diacritics off outside the Indic scripts, punctuation, symbols and controls to spaces, casefold, one space between words."""
    if not isinstance(text, str) or not text.strip():
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        out, at = [], 0
        for m in _INDIC_RUN.finditer(text):
            out += [_bare(text[at : m.start()]), m[0]]
            at = m.end()
        text = "".join([*out, _bare(text[at:])])
    return " ".join(_DROPPED.sub(" ", text).casefold().split())


def basic_clean(text: str | None) -> str:
    """The survey variant: diacritics go from characters below U+0500 only."""
    if not isinstance(text, str):
        return ""
    text = "".join(_bare(x) if ord(x) < 0x500 else x for x in unicodedata.normalize("NFKC", text))
    return " ".join(_DROPPED.sub(" ", text.casefold()).split())


def main_script(text: str | None) -> str:
    found = Counter(unicodedata.name(x, "UNKNOWN").split(" ")[0] for x in text or "" if x.isalpha())
    return found.most_common(1)[0][0].title() if found else "None"


def _places(text: str) -> dict[str, int]:
    """Of each character the places where it stands, as bits."""
    out: dict[str, int] = {}
    for k, x in enumerate(text):
        out[x] = out.get(x, 0) | 1 << k
    return out


def jaro_winkler_of(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    places, near, free, mine = _places(b), (1 << 2 * reach + 1) - 1, (1 << len(b)) - 1, []
    taken = 0
    for i, x in enumerate(a):
        within = near << i - reach if i >= reach else near >> reach - i
        if hit := places.get(x, 0) & within & free:
            hit &= -hit
            free ^= hit
            taken |= hit
            mine.append(x)
    if not mine:
        return 0.0
    m = len(mine)
    turned = sum(x != y for x, y in zip(mine, (y for k, y in enumerate(b) if taken >> k & 1))) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _indel(a: str, b: str) -> float:
    """2 * longest common subsequence / total length."""
    if not a and not b:
        return 1.0
    places, full = _places(b), (1 << len(b)) - 1
    row = full  # a zero bit for each step up in the row of lengths
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(b) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio_of(a: str, b: str) -> float:
    """Best of the ratios among the shared tokens and the shared ones with either side's own, 0 to 1."""
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both, own_a, own_b = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
    if both and (not own_a or not own_b):
        return 1.0
    with_a, with_b = (f"{both} {x}".strip() for x in (own_a, own_b))
    return max(_indel(with_a, with_b), _indel(both, with_a) if both else 0.0, _indel(both, with_b) if both else 0.0)


@F.pandas_udf(StringType())
def clean_text_udf(s: pd.Series) -> pd.Series:
    return s.map(clean)


@F.pandas_udf(StringType())
def basic_clean_udf(s: pd.Series) -> pd.Series:
    return s.map(basic_clean)


@F.pandas_udf(StringType())
def dominant_script(s: pd.Series) -> pd.Series:
    return s.map(main_script)


def _of_pairs(measure, a: pd.Series, b: pd.Series) -> pd.Series:
    """measure of each pair, worked out once for pairs that repeat in the batch."""
    pairs = list(zip(a.fillna(""), b.fillna("")))
    known = {x: measure(*x) for x in set(pairs)}
    return pd.Series([known[x] for x in pairs], dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_pairs(jaro_winkler_of, a, b)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_pairs(token_set_ratio_of, a, b)


def stable_number(text: str, seed: str = "") -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{text}".encode() if seed else text.encode(), digest_size=8).digest(), "big")


@F.pandas_udf(LongType())
def seeded_hash(ids: pd.Series, seed: pd.Series) -> pd.Series:
    """The seeded hash as a signed number of the same order."""
    return pd.Series([stable_number(x, y) - (1 << 63) for x, y in zip(ids, seed)], dtype="int64")


@F.pandas_udf(StringType())
def entity_split(ids: pd.Series) -> pd.Series:
    """fit (70 in 100), cal (15) or tune (15) by a hash of the id."""
    place = ids.map(lambda x: stable_number(str(x)) % 100)
    return pd.Series(["fit" if p < 70 else "cal" if p < 85 else "tune" for p in place])


def _accents() -> tuple[str, str]:
    """Precomposed Latin lower-case letters and the plain ones below them, by Unicode's own decomposition."""
    pairs = [(chr(c), _bare(chr(c))) for c in range(0xC0, 0x250) if chr(c).islower()]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def clean_latin(text: Column) -> Column:
    """clean() for text in Latin letters, in built-in functions."""
    lower = F.replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accents()), F.lit("ß"), F.lit("ss"))
    return F.btrim(F.regexp_replace(F.regexp_replace(lower, r"[\p{P}\p{S}\p{C}]+", " "), r"\s+", " "))


def _plainly(text: str) -> str:
    """What clean_latin() makes of a text."""
    lower = text.lower().translate(str.maketrans(*_accents())).replace("ß", "ss")
    return regex.sub(r"[ \t\n\x0b\f\r]+", " ", _DROPPED.sub(" ", lower)).strip(" ")


#: A character that clean_latin() reads otherwise than clean(): found by trying each below U+0250; all from there on count.
_NOT_PLAIN = "[" + "".join(f"\\x{{{c:X}}}" for c in range(0x250) if _plainly(f"a{chr(c)}a") != clean(f"a{chr(c)}a")) + "\\x{250}-\\x{10FFFF}]"


def clean_text(text: Column) -> Column:
    """clean() of any text: built-in functions where they give the same, Python for the other rows only."""
    other = F.regexp_like(text, F.lit(_NOT_PLAIN))
    return F.when(other, clean_text_udf(F.when(other, text))).otherwise(clean_latin(text))


def tokens(cleaned: Column) -> Column:
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def char_ngrams(cleaned: Column, n: int = 3) -> Column:
    """All n-grams of the text without spaces, repeats included; a shorter text is its own, an empty one has none."""
    joined = F.replace(cleaned, F.lit(" "), F.lit(""))
    size = F.length(joined)
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(joined)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(joined, i, F.lit(n))))


def numeric_keys(raw: Column) -> Column:
    """Distinct keys of the chunks with a digit: 4-8 gives 4 and 8; AF-0684 gives af684."""
    chunks = F.filter(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit("([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)"), F.lit(1)), lambda x: x.rlike("[0-9]"))

    def stripped(part: Column) -> Column:
        return F.when(part.rlike("^[0-9]+$"), F.regexp_replace(part, "^0+(?=.)", "")).otherwise(part)

    def keys(chunk: Column) -> Column:
        parts = F.split(F.lower(chunk), "-")
        return F.when(chunk.rlike("^[0-9]+(-[0-9]+)+$"), F.transform(parts, stripped)).otherwise(F.array(F.array_join(F.transform(parts, stripped), "")))

    return F.array_distinct(F.flatten(F.transform(chunks, keys)))


def digit_runs(cleaned: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(cleaned, F.lit(r"(\d+)"), F.lit(1)))


def written_out(words: Column) -> Column:
    forms = F.create_map(*[F.lit(x) for pair in LEGAL_FORMS.items() for x in pair])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(forms, t), t))


def location_tokens(raw: Column) -> Column:
    """Words of the last two comma-separated parts; none if there is one part."""
    parts = F.split(F.coalesce(raw, F.lit("")), ",")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.split(F.array_join(F.slice(parts, -2, 2), " "), r"\s+"), lambda x: x != "")))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return safe_ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return safe_ratio(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))
