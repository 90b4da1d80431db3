"""Scalar text functions as Columns: folding, tokens, stems, hashes, ranks. All are idempotent and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they fold to.
MARKED = "áàâäãåăéèêëíìîïóòôöõúùûüçñșşțţýÿ"
PLAIN = "aaaaaaaeeeeiiiiooooouuuucnssttyy"
#: Romanian suffixes in the order they are tried.
SUFFIXES = "urilor elor ilor urile ului iile ele ile uri lor iei ii ie ul ea ei le a ă e i".split()
#: Ranks of act types, lower binds higher; others have rank 9.
RANKS = {"constitutie": 0, "lege": 1, "oug": 1, "og": 1, "decret-lege": 1, "decret": 2, "hg": 3, "ordin": 4, "norma": 4, "instructiuni": 4}
#: Type names that have a slug of their own.
SLUGS = {"lege": "lege", "ordonanta de urgenta": "oug", "ordonanta": "og", "hotarare": "hg", "ordin": "ordin", "decret": "decret"}


def fold_key(c: Column) -> Column:
    """Comparison key: lower case, marks folded, runs of white space as one space; punctuation stays."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"\s+", " "))


def normalise(c: Column) -> Column:
    """One spelling of a passage, stable when applied again.

    Composes Romanian letters from base and mark, drops invisible characters, writes cedillas as commas, raised digits
    and `ind. 1` after a digit as ^1, typographic dashes and quotes plainly, runs of blanks as one, lines trimmed and at
    most one blank line between two.
    """
    for base, mark, letter in (("a", "\u0306", "ă"), ("a", "\u0302", "â"), ("i", "\u0302", "î"), ("s", "\u0326", "ș"), ("t", "\u0326", "ț"), ("s", "\u0327", "ș"), ("t", "\u0327", "ț")):
        c = F.replace(F.replace(c, F.lit(base + mark), F.lit(letter)), F.lit(base.upper() + mark), F.lit(letter.upper()))
    c = F.regexp_replace(c, "[\ufeff\u200b\u200c\u200d\u2060]", "")
    c = F.translate(c, "ŞşŢţ–—„”«»’", "ȘșȚț--\"\"\"\"'")
    c = F.regexp_replace(c, r"(?i)(?<=\d)\s*(?:ind\.|indice)\s*(\d+)", "^$1")
    c = F.translate(F.regexp_replace(c, "(?<=\\d)([¹²³⁴⁵⁶⁷⁸⁹]+)", "^$1"), "¹²³⁴⁵⁶⁷⁸⁹", "123456789")
    c = F.regexp_replace(c, "[ \t\u00a0\u2009\u202f]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def plain_romanian(c: Column) -> Column:
    """Without the marks of Romanian letters; case and everything else stays."""
    return F.translate(c, "ăĂâÂîÎșȘțȚ", "aAaAiIsStT")


def romanian_key(c: Column) -> Column:
    """What two passages are compared in: normalised, without marks, lower case, single blanks; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(plain_romanian(normalise(c))), "[ \t\u00a0\u2009\u202f]+", " "))


def without_markers(c: Column) -> Column:
    """Without lines that hold a lone +, keeping the break that they stand for."""
    return F.regexp_replace(c, r"\n[ \t]*\+[ \t]*(?=\n|\z)", "")


def tokens(c: Column) -> Column:
    """Distinct [a-z0-9]{3,} tokens of the key, first seen first."""
    return F.array_distinct(F.regexp_extract_all(fold_key(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def stem(c: Column) -> Column:
    """The token without the first suffix of the list that leaves at least four letters."""
    out = c
    for suffix in reversed(SUFFIXES):
        out = F.when(c.endswith(suffix) & (F.length(c) - len(suffix) >= 4), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(out)
    return out


def stem_phrase(c: Column) -> Column:
    """The stems of a phrase's words, which two inflections of a term share."""
    return F.array_join(F.transform(F.split(romanian_key(c), " "), stem), " ")


def slug(c: Column) -> Column:
    """Short name of an act type: of six types a fixed one, else derived from the name; unknown for none."""
    key = romanian_key(c)
    own = F.create_map(*(F.lit(x) for kv in SLUGS.items() for x in kv))[key]
    made = F.regexp_replace(F.regexp_replace(key, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(own, F.when(made == "", None).otherwise(made), F.lit("necunoscut"))


def legal_rank(c: Column) -> Column:
    """Rank of an act type's slug; 9 if unknown or null."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.coalesce(c, F.lit(""))], F.lit(9))


def may_amend(by: Column, target: Column) -> Column:
    """Whether an act of one type may amend one of the other: not above it in rank; a null type may always."""
    return by.isNull() | target.isNull() | (legal_rank(by) <= legal_rank(target))


def provision_key(act: Column, locator: Column) -> Column:
    return F.concat(F.lit("ro:"), act, F.when(locator.isNotNull(), F.concat(F.lit("#"), locator)).otherwise(""))


def contains_locator(outer: Column, inner: Column) -> Column:
    """Dotted-path containment: equal, or inner lies below outer. art1 doesn't contain art10."""
    return (inner == outer) | inner.startswith(F.concat(outer, F.lit(".")))


def query_terms(c: Column, stop: list[str], most: int = 12) -> Column:
    return F.slice(F.filter(tokens(c), lambda t: ~t.isin(stop)), 1, most)


def first_containing(c: Column, phrases: list[tuple[str, str]], otherwise: str, missing: str | None = None) -> Column:
    """The label of the first phrase that the key of c contains; `missing` for null or blank, `otherwise` for no phrase."""
    key = F.coalesce(romanian_key(c), F.lit(""))
    out = F.lit(otherwise)
    for phrase, label in reversed(phrases):
        out = F.when(F.contains(key, F.lit(phrase)), F.lit(label)).otherwise(out)
    return F.when(key == "", F.lit(missing if missing is not None else otherwise)).otherwise(out)


def keyword_class(fields: list[tuple[Column, int]], rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The rule whose words the fields hold with the greatest weight; ties go to the earlier rule.

    fields: (text, weight of a hit); rules: (label, words or phrases), met at word boundaries of the key.
    """
    scores = []
    for i, (label, words) in enumerate(rules):
        pattern = r"\b(" + "|".join(words) + r")\b"
        total = F.lit(0)
        for c, weight in fields:
            total = total + F.regexp_count(F.coalesce(romanian_key(c), F.lit("")), F.lit(pattern)) * weight
        scores.append(F.struct(total.alias("n"), F.lit(-i).alias("i"), F.lit(label).alias("label")))
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["label"]).otherwise(F.lit(otherwise))


def canonical_locator(c: Column) -> Column:
    """`art. 5 alin. (2) lit. a)` or `art5.alin2.lita` -> art5.alin2.lita; null unless the whole text says one position."""
    key = F.regexp_replace(romanian_key(c), r"[\s,.()]+", " ")
    spelled = r"^\s*(?:art(?:icol(?:ul|ului)?)?\s*(\d+(?:\^\d+)?))?\s*(?:alin(?:eat(?:ul|ului)?)?\s*(\d+(?:\^\d+)?))?\s*(?:lit(?:era|erei)?\s*([a-z](?:\^\d+)?))?\s*(?:(?:pct|punct(?:ul|ului)?)\s*(\d+(?:\^\d+)?))?\s*$"
    parts = [F.when(F.regexp_extract(key, spelled, i + 1) != "", F.concat(F.lit(name), F.regexp_extract(key, spelled, i + 1))) for i, name in enumerate(("art", "alin", "lit", "pct"))]
    path = F.concat_ws(".", *parts)
    return F.when(F.regexp_like(key, F.lit(spelled)) & (path != ""), path)


def content_hash(*fields: Column) -> Column:
    """sha256 of the fields as JSON in the order given; nulls stay apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*(f.alias(f"f{i:02d}") for i, f in enumerate(fields))), {"ignoreNullFields": "false"}), 256)


def snippet(text: Column, at: Column, n: Column, around: int = 110) -> Column:
    """The text around a span (from 1), with ellipses where it was cut."""
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + n + around - 1, F.length(text))
    cut = F.substring(text, start, end - start + 1)
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise(""))
