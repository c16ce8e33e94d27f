"""The driver queries of the search engine, with SQL that says the same by brute force.

The driver's tables hold no peptides; sequences are the letters of whole
documents, queries are 12-mers out of benchmark passages (which occur in
documents), and headers are synthesised in the FASTA header grammar.  The SQL
compares every window with every query, so it shares no seeding logic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.headers import metadata
from .operators import best, kmers, positional, results, search
from .plans.engine import materialise
from .plans.planner import auto_k, clamp_k, with_guarantee
from .recall import recall_percent, scan_hits
from .sources.index import ProteinIndex



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(text) -> F.Column:
    return F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", ""))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("protein_num"), _letters("text").alias("sequence"))


def queries_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-mers out of the middle of passages."""
    items = _table(spark, sf_dir, "benchmark")
    rows = items.select(F.col("item_id").alias("ordinal"), F.substring(_letters("text"), 11, 12).alias("query_seq"))
    return rows.select("ordinal", F.col("ordinal").cast("string").alias("query_id"), "query_seq")


def queries_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-mers one residue short of the passage they come from."""
    items = _table(spark, sf_dir, "benchmark")
    text = _letters("text")
    rows = items.select(F.col("item_id").alias("ordinal"), F.concat(F.substring(text, 11, 6), F.substring(text, 18, 6)).alias("query_seq"))
    return rows.select("ordinal", F.col("ordinal").cast("string").alias("query_id"), "query_seq")


def epitopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues 5, 9 and 14 of each passage, as a discontinuous query."""
    items = _table(spark, sf_dir, "benchmark")
    at = lambda i: F.concat(F.substring(_letters("text"), i, 1), F.lit(str(i)))
    return items.select(
        F.col("item_id").alias("ordinal"), F.col("item_id").cast("string").alias("query_id"),
        F.concat_ws(", ", at(5), at(9), at(14)).alias("query_seq"),
    )


_HEADER = """
  concat(case when doc_id % 3 = 0 then 'tr' else 'sp' end, '|D', cast(cast(floor(doc_id / 5) as bigint) as {text}),
         case when doc_id % 5 = 0 then '' else concat('-', cast(doc_id % 5 as {text})) end, '|D_X Text of ', coalesce(source, ''),
         case when doc_id % 11 = 0 then ' (Fragment)' else '' end, ' OS=Lingua ', coalesce(lang, ''), ' OX=', cast(9000 + doc_id % 9 as {text}),
         case when doc_id % 7 = 0 then '' else concat(' GN=', coalesce(source, '')) end,
         case when doc_id % 6 = 0 then '' else concat(' PE=', cast(doc_id % 4 as {text})) end,
         case when doc_id % 4 = 0 then '' else concat(' SV=', cast(1 + doc_id % 3 as {text})) end)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("protein_num"), F.expr(_HEADER.format(text="string")).alias("header"))


def _described(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.annotated(rows, metadata(headers(spark, sf_dir)))


def _plain(hits: DataFrame, *more) -> DataFrame:
    return hits.select("ordinal", "protein_num", F.col("start").cast("long").alias("start"), "matched", "edits", *more)


def exact_match(spark, sf_dir):
    """Flagship: exact search, one miss row for queries without a hit, protein metadata."""
    q = queries_12(spark, sf_dir)
    rows = results.substitution_rows(q, search.exact_hits(proteins(spark, sf_dir), q, 12))
    rows = _described(rows, spark, sf_dir)
    return rows.select("query_id", "query_seq", "matched", "protein_num", "index_start", "index_end", "positions", "protein_id", "gene", "gene_priority")


def exact_hits(spark, sf_dir):
    return _plain(search.exact_hits(proteins(spark, sf_dir), queries_12(spark, sf_dir), 6))


def exact_seed_voting(spark, sf_dir):
    return _plain(search.exact_hits_by_voting(proteins(spark, sf_dir), queries_12(spark, sf_dir), 5))


def exact_from_index(spark, sf_dir):
    """FASTA written and read, its index stored and read back, and the search made from the stored k-mer table."""
    materialise(spark.range(1))  # makes sure that the shared folder is set
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    records = proteins(spark, sf_dir).filter("sequence != ''").orderBy("protein_num")
    records.select(F.concat_ws("\n", F.concat(F.lit(">"), "protein_num"), "sequence")).write.text(f"{folder}/proteome.fasta")
    index = ProteinIndex(spark, f"{folder}/proteome.fasta", folder)
    index.build(8)
    hits = search.exact_hits(index.proteins, queries_12(spark, sf_dir), 8, index=index.kmers(8))
    names = index.proteins.select("protein_num", F.col("header").cast("long").alias("doc_id"))
    return _plain(hits.join(names, "protein_num").drop("protein_num").withColumnRenamed("doc_id", "protein_num"))


def _hamming(k, budget):
    def run(spark, sf_dir):
        return _plain(search.mismatch_hits(proteins(spark, sf_dir), queries_12(spark, sf_dir), k, budget))

    return run


def hamming_mutated_positions(spark, sf_dir):
    q = queries_12(spark, sf_dir)
    rows = results.substitution_rows(q, search.mismatch_hits(proteins(spark, sf_dir), q, auto_k(12, 2), 2))
    return rows.select("query_id", "query_seq", "matched", "protein_num", "edits", "positions", "index_start", "index_end")


def kmer_counts(spark, sf_dir):
    return kmers.kmers(proteins(spark, sf_dir), 5).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_postings(spark, sf_dir):
    """Posting lists of rare k-mers' table, reduced to their ends."""
    lists = kmers.postings(kmers.kmers(proteins(spark, sf_dir), 6))
    first, last = F.element_at("positions", 1), F.element_at("positions", -1)
    return lists.select(
        "kmer", "n", first["protein_num"].alias("first_protein"), first["pos"].cast("long").alias("first_pos"),
        last["protein_num"].alias("last_protein"), last["pos"].cast("long").alias("last_pos"),
    )


def _counts(budget):
    def run(spark, sf_dir):
        q = queries_12(spark, sf_dir)
        hits = search.mismatch_hits(proteins(spark, sf_dir), q, auto_k(12, budget), budget)
        return results.counts(q, hits).select("query_id", "query_seq", "mismatches", F.col("count").alias("n"))

    return run


def _indel(budget):
    def run(spark, sf_dir):
        return _plain(search.indel_hits(proteins(spark, sf_dir), queries_deleted(spark, sf_dir), auto_k(12, budget), budget))

    return run


def indel_positions_single(spark, sf_dir):
    q = queries_deleted(spark, sf_dir)
    rows = results.indel_rows(q, search.indel_hits(proteins(spark, sf_dir), q, 6, 1))
    return rows.filter("edits = 1").select("query_id", "query_seq", "matched", "protein_num", "index_start", "positions")


def _positional(budget):
    def run(spark, sf_dir):
        e = positional.parse(epitopes(spark, sf_dir))
        rows = results.positional_rows(e, positional.positional_hits(proteins(spark, sf_dir), e, budget))
        return rows.select("query_id", "query_seq", "matched", "protein_num", "edits", "positions", "index_start", "index_end")

    return run


def mixed_linear_discontinuous(spark, sf_dir):
    return hamming_mutated_positions(spark, sf_dir).unionByName(_positional(2)(spark, sf_dir))


def header_parse(spark, sf_dir):
    return metadata(headers(spark, sf_dir)).select(
        "protein_num", "protein_id", "protein_name", "species", "taxon_id", "gene", "sequence_version", "swissprot"
    )


def pe_inheritance(spark, sf_dir):
    return metadata(headers(spark, sf_dir)).select("protein_num", "pe_level")


def gene_priority(spark, sf_dir):
    return metadata(headers(spark, sf_dir)).select("protein_num", "gene_priority")


def versioned_accession(spark, sf_dir):
    rows = metadata(headers(spark, sf_dir))
    return rows.select("protein_num", results.versioned(F.col("protein_id"), F.col("sequence_version")).alias("accession"))


def metadata_join(spark, sf_dir):
    hits = search.exact_hits(proteins(spark, sf_dir), queries_12(spark, sf_dir), 6)
    rows = _described(hits, spark, sf_dir)
    return rows.select("ordinal", "protein_num", "protein_id", "species", "pe_level", "gene_priority", "swissprot")


def _best(explicit_k=None):
    def run(spark, sf_dir):
        q, p = queries_12(spark, sf_dir), proteins(spark, sf_dir)
        if explicit_k:
            hits = search.mismatch_hits(p, q, explicit_k, 2)
        else:
            hits = best.best_match_hits(p, q, materialise)
        rows = results.best_rows(_described(results.substitution_rows(q, hits), spark, sf_dir))
        return rows.select("query_id", "query_seq", "matched", "edits", "protein_num", "index_start", "protein_id")

    return run


def auto_k_of_batch(spark, sf_dir):
    shortest = search.QueryStats.of(queries_12(spark, sf_dir)).shortest
    return spark.range(1).select(*[F.lit(auto_k(shortest, m)).cast("long").alias(f"k_{m}") for m in range(4)])


def clamped_k(spark, sf_dir):
    """A requested k of 5, as the planner takes it for each number of edits."""
    shortest = search.QueryStats.of(queries_12(spark, sf_dir)).shortest
    return spark.range(1).select(*[F.lit(clamp_k(5, auto_k(shortest, m))).cast("long").alias(f"k_{m}") for m in range(4)])


def recall_guaranteed(spark, sf_dir):
    rows = with_guarantee(queries_12(spark, sf_dir), 5, 2)
    return rows.select("query_id", "recall_guaranteed")


def recall_metric(spark, sf_dir):
    """How many of the hits within 2 substitutions a search with 6-mer seeds finds."""
    want = _hamming(4, 2)(spark, sf_dir)
    got = _hamming(6, 2)(spark, sf_dir)
    return recall_percent(got, want, ["ordinal", "protein_num", "start", "matched"])


def query_split(spark, sf_dir):
    """A mixed batch, split into linear and discontinuous queries."""
    both = queries_12(spark, sf_dir).unionByName(epitopes(spark, sf_dir))
    return both.select("query_id", "query_seq", positional.is_discontinuous(F.col("query_seq")).alias("discontinuous"))


def brute_force_scan(spark, sf_dir):
    """The baseline without an index: every window against every query."""
    return _plain(scan_hits(proteins(spark, sf_dir), queries_12(spark, sf_dir), 0))


def brute_force_scan_m2(spark, sf_dir):
    return _plain(scan_hits(proteins(spark, sf_dir), queries_12(spark, sf_dir), 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "exact_match": exact_match,
        "exact_hits": exact_hits,
        "exact_seed_voting": exact_seed_voting,
        "exact_from_index": exact_from_index,
        "brute_force_scan": brute_force_scan,
        "brute_force_scan_m2": brute_force_scan_m2,
        "kmer_counts": kmer_counts,
        "kmer_postings": kmer_postings,
        "hamming_m1": _hamming(6, 1),
        "hamming_m2": _hamming(4, 2),
        "hamming_m3": _hamming(3, 3),
        "hamming_subthreshold_tiles": _hamming(6, 2),
        "hamming_subthreshold_overlapping": _hamming(5, 3),
        "hamming_mutated_positions": hamming_mutated_positions,
        "counts_only_exact": _counts(0),
        "counts_only_mismatch": _counts(2),
        "indel1": _indel(1),
        "indel2": _indel(2),
        "indel_positions_single": indel_positions_single,
        "discontinuous_exact": _positional(0),
        "discontinuous_m1": _positional(1),
        "mixed_linear_discontinuous": mixed_linear_discontinuous,
        "header_parse": header_parse,
        "pe_inheritance": pe_inheritance,
        "gene_priority": gene_priority,
        "versioned_accession": versioned_accession,
        "metadata_join": metadata_join,
        "best_match": _best(),
        "best_match_explicit_k": _best(4),
        "auto_k": auto_k_of_batch,
        "clamped_k": clamped_k,
        "recall_guaranteed": recall_guaranteed,
        "recall_metric": recall_metric,
        "query_split": query_split,
    }


# The same by brute force, in SQL.
_P = """
  p as (select doc_id as protein_num, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as sequence from documents),
  i as (select item_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as letters from benchmark)"""
_Q = ", q as (select item_id as ordinal, cast(item_id as varchar) as query_id, substr(letters, 11, 12) as query_seq from i)"
_QD = ", q as (select item_id as ordinal, cast(item_id as varchar) as query_id, substr(letters, 11, 6) || substr(letters, 18, 6) as query_seq from i)"


def _windows(*sizes: int) -> str:
    return ", w as (" + " union all ".join(
        f"select protein_num, start, substr(sequence, cast(start as int) + 1, {n}) as w from (select protein_num, sequence, unnest(range(0, length(sequence) - {n - 1})) as start from p)"
        for n in sizes
    ) + ")"


_META = """
  , h0 as (select doc_id as protein_num, {header} as header, doc_id from documents),
  h as (select protein_num, split_part(header, '|', 2) as protein_id,
          trim(split_part(substr(header, strpos(header, ' ') + 1), ' OS=', 1)) as protein_name,
          trim(regexp_extract(header, 'OS=(.*?)( OX=|$)', 1)) as species, regexp_extract(header, 'OX=(\\S*)', 1) as taxon_id,
          regexp_extract(header, 'GN=(\\S*)', 1) as gene, regexp_extract(header, 'PE=(\\S*)', 1) as pe,
          case when regexp_extract(header, 'SV=(\\S*)', 1) = '' then '1' else regexp_extract(header, 'SV=(\\S*)', 1) end as sv,
          starts_with(header, 'sp|') as swissprot from h0),
  canon as (select protein_id, max_by(pe, protein_num) as pe from h where protein_id not like '%-%' and pe <> '' group by 1),
  firsts as (select gene, min(protein_num) as protein_num from h where swissprot and protein_id not like '%-%' and gene <> '' group by 1),
  m as (select h.protein_num, nullif(h.protein_id, '') as protein_id, nullif(protein_name, '') as protein_name, nullif(species, '') as species,
          nullif(taxon_id, '') as taxon_id, nullif(h.gene, '') as gene,
          cast(case when h.protein_id like '%-%' and h.pe in ('', '0') and canon.pe is not null then canon.pe when h.pe = '' then '0' else h.pe end as bigint) as pe_level,
          cast(sv as bigint) as sequence_version, cast(firsts.protein_num is not null as bigint) as gene_priority, swissprot
        from h left join canon on canon.protein_id = split_part(h.protein_id, '-', 1) left join firsts on firsts.protein_num = h.protein_num)""".replace(
    "{header}", _HEADER.format(text="varchar")
)
_HIT = "select ordinal, protein_num, cast(start as bigint) as start, w as matched, cast({d} as bigint) as edits from w, q where {cond}"
_WRONG = "array_to_string(list_filter([{}], lambda x: x > 0), ', ')".format(
    ", ".join(f"case when substr(w, {i}, 1) <> substr(query_seq, {i}, 1) then {i} else 0 end" for i in range(1, 13))
)
_PLACES = f"'[' || {_WRONG} || ']'"


def _hamming_sql(budget: int, seed: str = "") -> str:
    cond = f"length(query_seq) = 12 and hamming(w, query_seq) <= {budget}" + (f" and ({seed})" if seed else "")
    return f"with {_P}{_Q}{_windows(12)} " + _HIT.format(d="hamming(w, query_seq)", cond=cond)


def _seeded(k: int, offsets: range) -> str:
    return " or ".join(f"substr(w, {o + 1}, {k}) = substr(query_seq, {o + 1}, {k})" for o in offsets)


_EXACT = f"with {_P}{_Q}{_windows(12)} " + _HIT.format(d="0", cond="w = query_seq")
_SUB = "rtrim(regexp_replace({}, '(.)', '\\1%', 'g'), '%')"


def _indel_sql(budget: int, select: str | None = None) -> str:
    sizes = [12 + e for e in range(-budget, budget + 1)]
    near = (
        "length(query_seq) = 12 and left(w, 1) = left(query_seq, 1) and right(w, 1) = right(query_seq, 1) and (w = query_seq"
        f" or (length(w) < 12 and query_seq like {_SUB.format('w')}) or (length(w) > 12 and w like {_SUB.format('query_seq')}))"
    )
    body = _HIT.format(d="abs(length(w) - 12)", cond=near)
    return f"with {_P}{_QD}{_windows(*sizes)} " + (select.format(hits=body) if select else body)


_RANGES = """, hits as ({hits}),
  spots as (
    select h.*, q.query_id, q.query_seq, pos from hits h join q using (ordinal), unnest(range(2, 13)) t(pos)
    where edits = 1 and case when length(matched) < 12
      then pos <= 11 and substr(query_seq, 1, cast(pos as int) - 1) || substr(query_seq, cast(pos as int) + 1) = matched
      else substr(matched, 1, cast(pos as int) - 1) || substr(matched, cast(pos as int) + 1) = query_seq end)
  select query_id, query_seq, matched, protein_num, start + 1 as index_start,
    (case when length(matched) < 12 then 'd: ' || substr(query_seq, cast(min(pos) as int), 1) else 'i: ' || substr(matched, cast(min(pos) as int), 1) end)
    || '[' || min(pos) || case when max(pos) > min(pos) then ',' || max(pos) else '' end || ']' as positions
  from spots group by query_id, query_seq, matched, protein_num, start"""

_E = """, e as (select item_id as ordinal, cast(item_id as varchar) as query_id, substr(letters, 5, 1) as r1, substr(letters, 9, 1) as r2, substr(letters, 14, 1) as r3 from i),
  x as (select *, r1 || '5, ' || r2 || '9, ' || r3 || '14' as query_seq from e),
  y as (select x.*, protein_num, substr(sequence, 5, 1) as a1, substr(sequence, 9, 1) as a2, substr(sequence, 14, 1) as a3 from x, p where length(sequence) >= 14),
  z as (select *, cast((a1 <> r1)::int + (a2 <> r2)::int + (a3 <> r3)::int as bigint) as edits from y)"""


def _positional_select(budget: int) -> str:
    return f"""select x.query_id, x.query_seq, a1 || '5, ' || a2 || '9, ' || a3 || '14' as matched, protein_num, edits,
        case when edits is null then '[]' else '[' || concat_ws(', ', case when a1 <> r1_ then '5' end, case when a2 <> r2_ then '9' end, case when a3 <> r3_ then '14' end) || ']' end as positions,
        case when edits is not null then 5::bigint end as index_start, case when edits is not null then 14::bigint end as index_end
      from x left join (select ordinal, protein_num, a1, a2, a3, r1 as r1_, r2 as r2_, r3 as r3_, edits from z where edits <= {budget}) z2 using (ordinal)"""


_MUTATED = f"""select q.query_id, q.query_seq, w as matched, protein_num, cast(d as bigint) as edits,
    case when w is null then '[]' else {_PLACES} end as positions, cast(start + 1 as bigint) as index_start, cast(start + 12 as bigint) as index_end
  from q left join (select ordinal as o, protein_num, start, w, hamming(w, query_seq) as d from w, q where length(query_seq) = 12 and hamming(w, query_seq) <= 2) on o = ordinal"""
_TIES = """row_number() over (partition by query_id order by edits, gene_priority desc nulls last, coalesce(cast(protein_id not like '%-%' as int), 0) desc,
    coalesce(cast(swissprot as int), 0) desc, pe_level nulls last, coalesce(cast(protein_name not like '%Fragment%' as int), 0) desc, protein_num, start)"""


def _best_sql(cond: str) -> str:
    return f"""with {_P}{_Q}{_windows(12)}{_META},
      hits as (select ordinal, query_id, query_seq, protein_num, start, w as matched, cast(hamming(w, query_seq) as bigint) as edits from w, q where length(query_seq) = 12 and {cond}),
      ranked as (select *, {_TIES} as n from hits left join m using (protein_num))
      select q.query_id, q.query_seq, matched, edits, protein_num, cast(start + 1 as bigint) as index_start, protein_id
      from q left join (select * from ranked where n = 1) r using (ordinal)"""


def oracle_sql() -> dict[str, str]:
    tiles_6, all_5 = _seeded(6, range(0, 7, 6)), _seeded(5, range(8))
    meta = f"with {_P}{_META} "
    counts = lambda hits: f"with h as ({hits}) select cast(h.ordinal as varchar) as query_id, substr(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 11, 12) as query_seq, edits as mismatches, count(*) as n from h join benchmark on item_id = ordinal group by 1, 2, 3"
    k5 = "select protein_num, start, w as kmer from w"
    return {
        "exact_match": f"""with {_P}{_Q}{_windows(12)}{_META}
            select q.query_id, q.query_seq, w.w as matched, w.protein_num, cast(start + 1 as bigint) as index_start, cast(start + 12 as bigint) as index_end,
              '[]' as positions, protein_id, gene, gene_priority
            from q left join w on w.w = q.query_seq left join m on m.protein_num = w.protein_num""",
        "exact_hits": _EXACT,
        "exact_seed_voting": _EXACT,
        "exact_from_index": _EXACT,
        "brute_force_scan": _EXACT,
        "brute_force_scan_m2": _hamming_sql(2),
        "kmer_counts": f"with {_P}{_windows(5)} select kmer, count(*) as n from ({k5}) group by 1",
        "kmer_postings": f"""with {_P}{_windows(6)} select kmer, count(*) as n, min(protein_num) as first_protein,
            cast(arg_min(start, protein_num * 1000000000 + start) as bigint) as first_pos, max(protein_num) as last_protein,
            cast(arg_max(start, protein_num * 1000000000 + start) as bigint) as last_pos from ({k5}) group by 1""",
        "hamming_m1": _hamming_sql(1),
        "hamming_m2": _hamming_sql(2),
        "hamming_m3": _hamming_sql(3),
        "hamming_subthreshold_tiles": _hamming_sql(2, tiles_6),
        "hamming_subthreshold_overlapping": _hamming_sql(3, all_5),
        "hamming_mutated_positions": f"with {_P}{_Q}{_windows(12)} {_MUTATED}",
        "counts_only_exact": counts(_EXACT),
        "counts_only_mismatch": counts(_hamming_sql(2)),
        "indel1": _indel_sql(1),
        "indel2": _indel_sql(2),
        "indel_positions_single": _indel_sql(1, _RANGES),
        "discontinuous_exact": f"with {_P}{_E} {_positional_select(0)}",
        "discontinuous_m1": f"with {_P}{_E} {_positional_select(1)}",
        "mixed_linear_discontinuous": f"with {_P}{_Q}{_windows(12)}{_E} {_MUTATED} union all {_positional_select(2)}",
        "header_parse": meta + "select protein_num, protein_id, protein_name, species, taxon_id, gene, sequence_version, swissprot from m",
        "pe_inheritance": meta + "select protein_num, pe_level from m",
        "gene_priority": meta + "select protein_num, gene_priority from m",
        "versioned_accession": meta + "select protein_num, protein_id || '.' || sequence_version as accession from m",
        "metadata_join": f"""with {_P}{_Q}{_windows(12)}{_META} select ordinal, protein_num, protein_id, species, pe_level, gene_priority, swissprot
            from (select * from w, q where w = query_seq) join m using (protein_num)""",
        "best_match": _best_sql("hamming(w, query_seq) <= 5"),
        "best_match_explicit_k": _best_sql("hamming(w, query_seq) <= 2"),
        "auto_k": f"with {_P}{_Q} select " + ", ".join(f"cast(greatest(2, min(length(query_seq)) // {m + 1}) as bigint) as k_{m}" for m in range(4)) + " from q",
        "clamped_k": f"with {_P}{_Q} select " + ", ".join(f"cast(least(5, greatest(2, min(length(query_seq)) // {m + 1})) as bigint) as k_{m}" for m in range(4)) + " from q",
        "recall_guaranteed": f"with {_P}{_Q} select query_id, length(query_seq) >= 15 as recall_guaranteed from q",
        "recall_metric": f"""with want as ({_hamming_sql(2)}), got as ({_hamming_sql(2, tiles_6)})
            select count(*) as expected, cast(sum(cast(g.ordinal is not null as int)) as bigint) as found, least(100.0 * sum(cast(g.ordinal is not null as int)) / count(*), 100.0) as recall
            from want left join got g using (ordinal, protein_num, start, matched)""",
        "query_split": f"""with {_P}{_Q}{_E} select query_id, query_seq, false as discontinuous from q
            union all select query_id, query_seq, true as discontinuous from x""",
    }
