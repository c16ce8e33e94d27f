"""Discontinuous queries: residues at given positions of a protein, e.g. 'N1, A3, L5'."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

_PATTERN = r"^.[0-9]+(, .[0-9]+)*$"
_RESIDUES = "array<struct<residue:string,pos:bigint>>"


def is_discontinuous(query: Column) -> Column:
    return query.rlike(_PATTERN)


def parse(queries: DataFrame) -> DataFrame:
    """ordinal, query_id, query_seq (re-rendered), residues of the discontinuous queries."""
    item = lambda x: F.struct(
        F.substring(x, 1, 1).alias("residue"), F.regexp_replace(x, "^.", "").cast("long").alias("pos")
    )
    found = queries.filter(is_discontinuous(F.col("query_seq")))
    found = found.withColumn("residues", F.transform(F.split("query_seq", ", "), item).cast(_RESIDUES))
    return found.withColumn("query_seq", render(F.col("residues")))


def render(residues: Column) -> Column:
    return F.array_join(F.transform(residues, lambda r: F.concat(r["residue"], r["pos"].cast("string"))), ", ")


def positional_hits(proteins: DataFrame, epitopes: DataFrame, budget: int) -> DataFrame:
    """ordinal, protein_num, matched, edits, positions, first, last: at most one row per protein and query.

    All listed positions must exist in the protein and at most `budget` residues
    differ.  The epitopes are typed by hand and few; they enter the scan as one
    constant, so the proteins are only filtered.
    """
    listed = [(r["ordinal"], [(x["residue"], x["pos"]) for x in r["residues"]]) for r in epitopes.select("ordinal", "residues").collect()]
    text = json.dumps([{"ordinal": o, "res": [{"residue": a, "pos": p} for a, p in rs]} for o, rs in listed])
    constant = F.from_json(F.lit(text), f"array<struct<ordinal:bigint,res:{_RESIDUES}>>")
    rows = spread(proteins.select("protein_num", "sequence"))
    at = lambda r: F.substring(F.col("sequence"), r["pos"].cast("int"), F.lit(1))
    wrong = lambda e: F.filter(e["res"], lambda r: at(r) != r["residue"])
    inside = lambda e: F.forall(e["res"], lambda r: (r["pos"] >= 1) & (r["pos"] <= F.length("sequence")))
    rows = rows.select("protein_num", "sequence", F.explode(F.filter(constant, lambda e: inside(e) & (F.size(wrong(e)) <= budget))).alias("e"))
    e = F.col("e")
    matched = F.transform(e["res"], lambda r: F.concat(at(r), r["pos"].cast("string")))
    places = F.transform(wrong(e), lambda r: r["pos"].cast("string"))
    return rows.select(
        e["ordinal"].alias("ordinal"), "protein_num",
        F.array_join(matched, ", ").alias("matched"), F.size(wrong(e)).cast("long").alias("edits"),
        F.concat(F.lit("["), F.array_join(places, ", "), F.lit("]")).alias("positions"),
        F.element_at(e["res"], 1)["pos"].alias("first"), F.element_at(e["res"], -1)["pos"].alias("last"),
    )
