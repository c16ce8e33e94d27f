import os
import random

from pyspark.sql import functions as F

from strandline.llm import html_text as ht


def body(html):
    lines, kinds = ht.page_lines(html)
    return [t for t, k in zip(lines, kinds, strict=True) if k == 1]


def test_structure():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><article>';</script></head><body>"
        "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy</div><header>Site</header>"
        "<article><h1>A &amp;amp; B</h1><p><b>One\n\t two<br>three<p>Four &lt;x&gt;&nbsp;&#233;<form>f</form><aside>side</aside>"
        "<div class='comments'><p>Reader</p></div><ul><li>i</li><li>j</li></ul></article><section id=comments><article>c</article></section>"
        "<footer>&copy; F</footer>"
    )
    assert body(page) == ["A &amp; B", "One two three", "Four <x> é", "i", "j"]
    assert body("<article><p>cut off") == ["cut off"]
    assert body("<main><p>a<p>b</main><p>c") == ["a", "b"]
    assert body("<nav><a>m</a><article><p>x</p></article>") == ["x"]
    assert body("<article>1 < 2 <i>and</i> 3 > 2<p hidden>no</p><p style='display: none'>no</article>") == ["1 < 2 and 3 > 2"]
    assert body("<article><p>a <span class='ad-box'>x <b>y</b></span> b <button>z</button>c</p>d</article>") == ["a b c", "d"]
    assert body("<article>a <span class=promo>x<p>y</p></span> b</article>") == ["a", "b"]
    assert ht.page_lines(None) == ([], []) and ht.page_lines("plain") == (["plain"], [0])


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_common_lines_are_a_longest_common_subsequence():
    for seed in range(500):
        rng = random.Random(seed)
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        hit = [x for x, h in zip(a, ht.common_lines(a, b), strict=True) if h]
        rest = iter(b)
        assert all(x in rest for x in hit) and len(hit) == lcs_length(a, b)


def page(rows):
    return "".join(f"<div>{r}</div>" for r in rows)


def test_differencing_of_pages_without_a_declared_body(spark):
    top, end = ["Site name", "Home", "News"], ["About us", "Imprint"]
    rows = [(i, f"http://h{i % 2}.org/a/{i}?q=1#x", page([*top, f"story {i}", "Home stretch", f"more {i}", *end])) for i in range(12)]
    rows[6] = (6, rows[4][1], rows[4][2])  # a copy of its neighbour
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumn("hashes", F.lit(1))
    out = {r.page_id: r for r in ht.extract_pages(df).collect()}
    assert out[3].text == "story 3\nmore 3" and out[3].n_chars == 14
    assert out[6].text == out[4].text == "story 4\nmore 4"
    assert len(out) == 12 and all(r.text for r in out.values())


def test_shared_lines_of_a_declared_body_stay_and_edges(spark):
    rows = [(i, "http://h.org/p", f"<nav>m</nav><article><p>Same line</p><p>{i}</p></article>") for i in range(3)]
    rows += [(9, None, None), (9, None, None), (10, "not a url", "<p></p>"), (None, "http://[bad", "<article>x</article>"), (11, "http://lone.org/", "<p>only</p>")]
    out = ht.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [
        (0, "Same line\n0", 11), (0, "x", 1), (1, "Same line\n1", 11), (2, "Same line\n2", 11),
        (9, "", 0), (9, "", 0), (10, "", 0), (11, "only", 4),
    ]
    assert ht.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pairs_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    lines = [f"line {i}" for i in range(30)]
    rows = [(i, f"http://h.org/{rng.randint(0, 40)}/{i}", page(rng.sample(lines, 12))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted((r.page_id, r.text) for r in ht.extract_pages(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_all_copies_of_a_run_lose_what_they_share_with_the_pages_around(spark):
    top, end = ["Site name", "Home", "News"], ["About us", "Imprint"]
    html = lambda name: page([*top, f"story {name}", f"more {name}", *end])
    rows = [(0, "http://h.org/a/0", html("first")), (90, "http://h.org/z/9", html("last"))]
    rows += [(i, "http://h.org/m/1", html("copy")) for i in range(10, 14)]  # one page crawled again
    rows += [(i, f"http://h.org/m/{i}", html("copy")) for i in range(20, 40)]  # and under other paths
    rows += [(i, f"http://other.org/{i}", html("copy")) for i in range(40, 43)]  # copies only: no partner
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "3", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            out = {r.page_id: r.text for r in ht.extract_pages(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {out[i] for i in (*range(10, 14), *range(20, 40))} == {"story copy\nmore copy"}
        assert out[0] == "story first\nmore first" and out[90] == "story last\nmore last"
        assert {out[i] for i in range(40, 43)} == {"\n".join([*top, "story copy", "more copy", *end])}


def test_edges_of_partitions_like_one_partition():
    import pyarrow as pa

    def batch(pid, rows):
        return pa.RecordBatch.from_pylist([{"pid": pid, "open": i, "host": p[0], "path": p[1], "hashes": p[2]} for i, p in rows])

    def shared(parts):
        parts = [batch(pid, rows) for pid, rows in enumerate(parts) if rows]
        ends = {}
        for r in (r for part in parts for b in ht._ends(iter([part])) for r in b.to_pylist()):
            ends.setdefault(r["pid"], {})[r["k"]] = (r["host"], r["path"], r["hashes"])
        differ = ht._differ(ht._edges(ends))
        return {r["rid"]: r["shared"] for part in parts for b in differ(iter([part])) for r in b.to_pylist()}

    for seed in range(300):
        rng = random.Random(seed)
        pages = sorted((rng.choice("ab"), rng.choice("pqr") * rng.randint(1, 3), rng.choice([[1, 2, 3], [1, 2, 4], [1, 5], []])) for _ in range(14))
        rows = list(enumerate(pages))
        cuts = sorted(rng.randint(0, 14) for _ in range(5))
        whole = shared([rows])
        assert len(whole) == 14 and shared([rows[a:z] for a, z in zip([0, *cuts], [*cuts, 14], strict=True)]) == whole
        for i, (host, _, hashes) in rows[1:]:  # copies side by side get the same
            assert pages[i - 1][::2] != (host, hashes) or whole[i] == whole[i - 1]


def brute_extraction(rows):
    """page_id -> text, for rows (id, url, [(line, where)]) with where in body, boilerplate, plain; ids distinct."""
    order = sorted(rows, key=lambda r: (*ht.url_key(r[1]), r[0]))
    out = {}
    for n, (i, url, lines) in enumerate(order):
        own, (host, _) = [t for t, _ in lines], ht.url_key(url)
        alike = lambda r: ht.url_key(r[1])[0] == host and [t for t, _ in r[2]] == own  # noqa: B023, E731
        first = last = n
        while first and alike(order[first - 1]):
            first -= 1
        while last + 1 < len(order) and alike(order[last + 1]):
            last += 1
        near = []
        for at, end in ((first - 1, first), (last + 1, last)):
            if 0 <= at < len(order) and ht.url_key(order[at][1])[0] == host:
                prefix = os.path.commonprefix([ht.url_key(order[at][1])[1], ht.url_key(order[end][1])[1]])
                near.append((-len(prefix), at))
        shared = set()
        for _, at in sorted(near, key=lambda p: p[0]):
            other = [t for t, _ in order[at][2]]
            if lcs_length(own, other) < len(own):  # lines are distinct in a page here, so the subsequence is one set
                shared = {t for t, h in zip(own, ht.common_lines(own, other), strict=True) if h}
                break
        declares = any(w == "body" for _, w in lines)
        kept = []
        for t, w in lines:
            vote = {"body": 1, "boilerplate": -1, "plain": -1 if declares else 0}[w]
            total = vote + (-1 if t in shared else 1)
            if total > 0 or (total == 0 and vote > 0):
                kept.append(t)
        out[i] = "\n".join(kept)
    return out


def test_whole_extraction_against_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows, html = [], []
        for i in range(80):
            menu = [(f"menu {k}", rng.choice(["boilerplate", "plain"])) for k in range(3)]
            body = [(f"story {rng.choice([i, 'of all'])} part {k}", "body" if i % 3 else "plain") for k in range(rng.randint(0, 4))]
            lines = [*menu, *body, (f"end {rng.randint(0, 2)}", "plain")]
            if i and rng.random() < 0.2:
                lines = rows[-1][2]
            tag = {"plain": "<div>{}</div>", "boilerplate": "<nav><b>{}</b></nav>", "body": "<article><p>{}</p></article>"}
            rows.append((i, f"http://h{rng.randint(0, 2)}.org/{rng.choice('abc')}/{rng.randint(0, 50)}", lines))
            html.append("".join(tag[w].format(t) for t, w in lines))
        df = spark.createDataFrame([(i, u, h) for (i, u, _), h in zip(rows, html, strict=True)], "page_id long, url string, html string")
        out = {r.page_id: r.text for r in ht.extract_pages(df.repartition(5)).collect()}
        assert out == brute_extraction(rows)


def test_very_long_page(spark):
    body = "".join(f"<p>line {i} &amp; more</p>" for i in range(60_000))
    rows = [(1, "http://h.org/1", f"<nav>x</nav><article>{body}</article>"), (2, "http://h.org/2", "<p>" + "word " * 400_000 + "</p>")]
    out = {r.page_id: r for r in ht.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text.count("\n") == 59_999 and out[1].text.startswith("line 0 & more\nline 1 ")
    assert out[2].n_chars == 400_000 * 5 - 1


def test_pages_that_declare_their_body_are_aligned_too():
    import pyarrow as pa

    html = "<nav>m</nav><article><p>a</p><p>b</p></article>"
    batch = pa.RecordBatch.from_pylist([{"page_id": 1, "url": "http://h.org/1", "html": html, "th": 7}])
    (row,) = (r for b in ht._cut(iter([batch])) for r in b.to_pylist())
    assert row["votes"] == [-1, 1, 1] and len(row["hashes"]) == 3 and "text" not in row


def test_repeated_rows_have_one_text_however_they_are_dealt(spark):
    top, end = ["Site name", "Home"], ["About us"]
    html = {k: page([*top, f"story {k}", *more, *end]) for k, more in (("a", ["x"]), ("b", ["x"]), ("c", []))}
    rows = [(i % 2, "http://h.org/p", html[k]) for i, k in enumerate("abcabcabcaabbcc")] + [(None, None, html["a"])] * 3
    want = None
    for n in (1, 4, 15):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        out = ht.extract_pages(df).collect()
        texts = {(r.page_id, r.url, r.text) for r in out}
        assert len(out) == len(rows) and (want is None or texts == want)
        want = texts
    assert len(want) <= 7
