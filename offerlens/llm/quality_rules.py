"""Quality rules: a threshold table compiled into one projection, without user functions.

Every rule compares one ratio or count of a document with a bound. The table below is data;
`compile_rules` turns it into a single boolean Column, so Catalyst evaluates all rules in the
scan stage with no shuffle, no Python and no second pass over the text.

Defined cases: a null or blank text has no words, fails the base rule (n_words < 50) and is not
kept; no text fails for being long. Stop words count as they stand, lower-case and without punctuation. A text without lines or letters has ratio 0 for that measure. Repeated rows are judged one by
one. Extra columns are ignored. Texts of any length are judged whole; n-gram repeats cost
O(n log n) of the document's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import SPACE_CLASS

SYMBOLS = "[#*$%&|<>]"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Function words of the four languages: fixed values.
STOP_WORDS = (
    "a an and are as at be by for from have he her his if in is it its not of on or she that the their they this to was were will with you "
    "al como con de del el en es la las lo los más no para por que se su sus un una y "
    "au aux avec ce ces dans des du elle est et il ils je le les leur mais nous ou par pas pour qui sur une vous "
    "auf aus bei das dem den der die ein eine er es für hat ich im ist mit nach nicht sich sie sind über und von war wie zu zum"
).split()

#: (measure, comparison that a kept document meets, bound). Bounds are wide of ordinary prose.
RULES: tuple[tuple[str, str, float], ...] = (
    ("n_words", ">=", 50),
    ("mean_word_length", ">=", 3.0),
    ("mean_word_length", "<=", 12.0),
    ("symbol_ratio", "<=", 0.1),
    ("repeat_word_ratio", "<=", 0.5),
    ("dup_line_ratio", "<=", 0.5),
    ("stop_word_ratio", ">=", 0.02),
    ("upper_ratio", "<=", 0.5),
)

def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _repeat_words(w: Column) -> Column:
    """Words of w within 3-word windows that occur twice or more.

    The windows' hashes are sorted with their places, so that equal windows are neighbours; the
    places that have an equal neighbour, in order, cover three words each.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda g, x, k: F.coalesce(F.get(g, k)["h"] == x["h"], F.lit(False))
        return _let(pairs, lambda g: F.transform(F.filter(g, lambda x, k: same(g, x, k - 1) | same(g, x, k + 1)), lambda x: x["i"]))

    def covered(h: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        walked = F.aggregate(F.sort_array(places(h)), first, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(walked)

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, covered))


def measures(text: Column) -> Column:
    """struct of the base counts and the ratios that RULES name."""
    raw = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(raw, f"{SPACE_CLASS}+"), "")
    lines = F.filter(F.split(raw, "\n"), lambda line: line.rlike(WORD_CHAR))

    def counted(s: Column) -> Column:
        w, x = s["w"], s["l"]
        counts = {
            "n_words": F.size(w), "word_chars": F.length(F.concat_ws("", w)), "n_symbols": F.regexp_count(raw, F.lit(SYMBOLS)), "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
            "n_repeat_words": _repeat_words(w), "n_lines": F.size(x), "n_stop": F.size(F.filter(w, lambda v: v.isin(*dict.fromkeys(STOP_WORDS)))),
            "n_upper": F.regexp_count(raw, F.lit(r"\p{Lu}")),
        }
        return F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])

    def rated(c: Column) -> Column:
        ratios = {
            "mean_word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "repeat_word_ratio": ("n_repeat_words", "n_words"),
            "dup_line_ratio": ("n_dup_lines", "n_lines"), "stop_word_ratio": ("n_stop", "n_words"), "upper_ratio": ("n_upper", "word_chars"),
        }
        kept = [c[n].alias(n) for n in COUNTS]
        return F.struct(*kept, *[_ratio(c[a], c[b]).alias(n) for n, (a, b) in ratios.items()])

    return _let(_let(F.struct(words.alias("w"), lines.alias("l")), counted), rated)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def compile_rules(m: Column, rules: tuple[tuple[str, str, float], ...] = RULES) -> Column:
    """One boolean Column over the measures m: true if they meet every rule of the table."""
    verdict = ~base_failed(m)
    for measure, sign, bound in rules:
        verdict = verdict & _COMPARE[sign](m[measure], F.lit(bound))
    return verdict


def quality(docs: DataFrame, rules: tuple[tuple[str, str, float], ...] = RULES) -> DataFrame:
    """(doc_id, counts, ratios, base_failed, kept) per row of docs."""
    judged = _let(measures(F.col("text")), lambda m: F.struct(m.alias("m"), base_failed(m).alias("base_failed"), compile_rules(m, rules).alias("kept")))
    return docs.select("doc_id", judged.alias("j")).select("doc_id", "j.m.*", "j.base_failed", "j.kept")


def keep(docs: DataFrame, rules: tuple[tuple[str, str, float], ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their columns as they were."""
    return docs.where(_let(measures(F.col("text")), lambda m: compile_rules(m, rules)))
