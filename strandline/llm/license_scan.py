"""License scan with ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z only) and reduced to its words ([0-9a-z] and
everything beyond ASCII), joined by single spaces.  The rules of `license_rules`
are regular expressions over that form, each with a label, a priority and a keyword.

1.  One literal test (a trie of all keywords) passes on the few documents that
    can match at all; the others cost no more than that.
2.  Of those, the keywords found in a document pick the rules to run; the rule
    table is a constant of the plan.
3.  Each rule marks its matches in the text; cut at the blanks, the marks give
    word intervals in one pass, whatever the number of matches.
4.  Overlapping detections are resolved: an interval contained in one of
    higher priority (or of the same priority and larger, or equal and earlier
    in the rule order) is suppressed.  In the order of starts that is a running
    maximum of stops for each priority: windows over the detections of a row,
    so n detections cost one sort.  Rows without a detection do not move.

The base phrases are counted apart and never suppressed.  Null is empty text;
documents without any detection have empty labels, null positions and score 0.
The score is the highest confidence of a surviving detection (a base phrase: 1).
Rows are told apart by position, so repeated ids keep a row each.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .license_rules import keywords, rules

BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def trie(words: list[str]) -> str:
    """A regular expression for exactly these words that decides letter by letter."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        tails.setdefault(w[:1], []).append(w[1:])
    branches = ["" if not c else c + (trie(rest) if rest != [""] else "") for c, rest in sorted(tails.items(), reverse=True)]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _n_words(s: Column) -> Column:
    """Words of a normalised string (single spaces between them, any around them)."""
    trimmed = F.trim(s)
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


def _lower(s: Column) -> Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.length(s) == F.octet_length(s)
    return F.when(ascii_only, F.lower(s)).otherwise(F.translate(s, upper, upper.lower()))


#: Everything that separates words; case is kept, so A-Z is not a separator here.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


_INTERVALS = "array<struct<start:bigint,stop:bigint>>"


def _intervals(norm: Column, pattern: Column) -> Column:
    """(start, stop) in words of every match of `pattern` (whole words) in ' w1 w2 ... '.

    Matches are put between two control characters, which the words cannot hold.
    """
    whole = F.concat(F.lit("(?<= )("), pattern, F.lit(")(?= )"))
    words = F.split(F.ltrim(F.regexp_replace(norm, whole, F.lit("\x01$1\x02"))), " ")
    place = lambda mark, shift: F.filter(
        F.transform(words, lambda w, i: F.when(mark(w), (i + shift).cast("long"))), lambda i: i.isNotNull()
    )
    starts, stops = place(lambda w: w.startswith("\x01"), 0), place(lambda w: w.endswith("\x02"), 1)
    found = F.arrays_zip(starts.alias("start"), stops.alias("stop")).cast(_INTERVALS)
    return F.when(F.rlike(norm, whole), found).otherwise(F.array().cast(_INTERVALS))


def _survivors(found: DataFrame) -> DataFrame:
    """Detections (rid, start, stop, priority, ord, ...) that no other one suppresses."""
    before = Window.partitionBy("rid").orderBy("start", F.col("stop").desc()).rangeBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("rid", "priority").orderBy("start", F.col("stop").desc(), "ord")
    over = F.lit(False)
    for level in sorted({r.priority for r in rules()})[:-1]:
        higher = F.max(F.when(F.col("priority") > level, F.col("stop"))).over(before)
        over |= (F.col("priority") == level) & F.coalesce(higher >= F.col("stop"), F.lit(False))
    same = F.max("stop").over(alike.rowsBetween(Window.unboundedPreceding, -1))
    over |= F.coalesce(same >= F.col("stop"), F.lit(False))
    return found.withColumn("over", over).filter("not over").drop("over")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    listed = rules()
    keys = keywords()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _GAPS, " ")), F.lit(" "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    gate = f"(?i) {trie([*keys, *(p.split(' ')[0] for p in BASE)])} "
    gated = F.col("norm").rlike(gate)
    scanned = rows.select(
        "doc_id",
        _n_words(F.col("norm")).cast("long").alias("n_words"),
        F.when(gated, _lower(F.col("norm"))).alias("norm"),
    )

    # rules by keyword, a constant of the plan: a document runs those whose keyword it holds
    by_key = [
        {"keyword": k, "rules": [
            {"ord": r.order, "label": r.label, "priority": r.priority, "confidence": r.confidence, "pattern": r.pattern}
            for r in listed if r.keyword == k
        ]}
        for k in keys
    ]
    constant = F.from_json(F.lit(json.dumps(by_key)), f"array<struct<keyword:string,rules:array<{_RULE}>>>")
    present = F.filter(constant, lambda k: F.contains(F.col("norm"), F.concat(F.lit(" "), k["keyword"], F.lit(" "))))
    chosen = F.flatten(F.transform(present, lambda k: k["rules"]))
    found = F.flatten(
        F.transform(
            chosen,
            lambda r: F.transform(
                _intervals(F.col("norm"), r["pattern"]),
                lambda m: F.struct(
                    m["start"].alias("start"), m["stop"].alias("stop"), r["priority"].alias("priority"),
                    r["ord"].alias("ord"), r["label"].alias("label"), r["confidence"].alias("confidence"),
                ),
            ),
        )
    )
    named = lambda label: lambda m: F.struct(m["start"].alias("start"), F.lit(label).alias("label"))
    base = F.flatten(
        F.array(*[F.transform(_intervals(F.col("norm"), F.lit(p)), named(label)) for p, label in BASE.items()])
    )
    open_row = F.col("norm").isNotNull()
    hit = scanned.select(
        "doc_id", "n_words",
        F.when(open_row, found).otherwise(F.array().cast(_FOUND)).alias("found"),
        F.when(open_row, base).otherwise(F.array().cast("array<struct<start:bigint,label:string>>")).alias("base"),
    )
    hit = stored(hit.withColumn("rid", F.monotonically_increasing_id()))
    kept = _survivors(hit.select("rid", F.inline("found")))
    detection = F.struct("start", "stop", "priority", "ord", "label", "confidence")
    kept = kept.groupBy("rid").agg(F.array_sort(F.collect_list(detection)).alias("detections"))
    plain = hit.filter(F.size("found") == 0).withColumn("detections", F.array().cast(_FOUND))
    rich = hit.filter(F.size("found") > 0).join(kept, "rid")
    hit = plain.select("doc_id", "n_words", "base", "detections").unionByName(rich.select("doc_id", "n_words", "base", "detections"))
    return hit.select(*_columns(F.col("base"), F.col("detections")))


_RULE = "struct<ord:int,label:string,priority:int,confidence:double,pattern:string>"
_FOUND = "array<struct<start:bigint,stop:bigint,priority:int,ord:int,label:string,confidence:double>>"


def _columns(base: Column, kept: Column) -> list:
    starts = F.transform(base, lambda m: m["start"])
    own = F.transform(base, lambda m: m["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.aggregate(kept, F.lit(0.0), lambda a, m: F.greatest(a, m["confidence"]))
    return [
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.transform(kept, lambda m: m["label"]))).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(best).alias("score"), kept.cast(_FOUND).alias("detections"),
    ]
