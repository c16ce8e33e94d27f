import re
import time

from pyspark.sql import functions as F

from strandline.llm import license_scan as ls
from strandline.llm.license_rules import keywords

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(text):
    words = WORD.findall(lower(text or ""))
    places = []
    for phrase, label in ls.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    norm, found = f" {' '.join(words)} ", []
    for r in ls.rules():
        if f" {r.keyword} " in norm:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, r.priority, r.order, r.label, r.confidence))

    def covered(b):
        return any(
            a[3] != b[3] and a[0] <= b[0] and a[1] >= b[1]
            and (a[2], a[1] - a[0], -a[3]) > (b[2], b[1] - b[0], -b[3])
            for a in found
        )

    kept = [f for f in found if not covered(f)]
    labels = {p[1] for p in places}
    score = 1.0 if places else max((f[5] for f in kept), default=0.0)
    starts = [p[0] for p in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {f[4] for f in kept})), score,
    )


TEXTS = [
    None, "", "...", "MIT License", "the mit-license; and again MIT\nLICENSE", "Apache License, Version 2.0", "mitlicense",
    "Licensed under the GNU General Public License version 3 or any later version", "CC BY-NC-SA 4.0 and cc by cc by",
    "SPDX-License-Identifier: BSD 3-Clause", "Creative Commons Attribution ShareAlike 4.0 International",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "©MIT License", "K İ MİT License mıt license",
    "All rights reserved. " * 50, "GPL v2 gpl 2.0 GPL-2.1 gnu gpl", "new BSD license, 2 clause bsd", "x " * 20_000 + "mit license",
    "é mit license é cc  by\x00sa", "the the licensed under the terms of the mozilla public license 2",
]


def test_matches_brute_force(spark, sf_dir):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("norm", F.lit("x"))
    out = {r.doc_id: r for r in ls.license_scan(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(t), repr(t)[:90]


def test_rules_rows_and_plan(spark):
    listed = ls.rules()
    assert len(listed) > 300 and len({(r.label, r.pattern) for r in listed}) == len({(r.label, r.pattern, r.keyword) for r in listed})
    for r in listed:
        re.compile(r.pattern)
    df = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "gpl")], "doc_id long, text string")
    out = ls.license_scan(df)
    assert sorted((r.doc_id or 0, r.n_base) for r in out.collect()) == [(0, 0), (1, 1), (1, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert ls.license_scan(df.limit(0)).collect() == []


def _literal_words(pattern):
    """Words that every match holds: optional groups and alternatives aside."""
    while True:
        bare = re.sub(r"\((?:\?:)?[^()]*\)[?*]|\((?:\?:)?[^()]*\|[^()]*\)", "~", pattern)
        if bare == pattern:
            return bare.replace("~", " ").split()
        pattern = bare


def test_every_match_holds_its_keyword():
    assert all(r.keyword in _literal_words(r.pattern) for r in ls.rules())


def test_gate_is_the_list_of_keywords():
    gate = re.compile(ls.trie(keywords()))
    assert all(gate.fullmatch(k) for k in keywords())
    assert not any(gate.fullmatch(k + "x") or gate.fullmatch(k[:-1]) for k in keywords() if k[:-1] not in keywords() and k + "x" not in keywords())


def test_megabyte_of_notices(spark):
    notice = "Licensed under the Apache License, Version 2.0 (the MIT license; GPL v2 or any later). All rights reserved. "
    n = 1_000_000 // len(notice)
    df = spark.createDataFrame([(1, notice * n), (2, notice)], "doc_id long, text string")
    begin = time.time()
    out = {r.doc_id: r for r in ls.license_scan(df).collect()}
    assert time.time() - begin < 60
    assert out[1].labels == out[2].labels and out[1].n_base == n * out[2].n_base and out[2].n_base == 2
    assert len(out[1].detections) == n * len(out[2].detections)
