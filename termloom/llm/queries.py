"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from termloom.llm import decontam, hnsw, html_extract, license_scan, line_dedup, minhash_join, mixing, pii_crf, quality, secret_ledger, simhash_golay, vector_codes, word_runs
from termloom.llm.common import read


def simhash_query(spark, sf_dir):
    return simhash_golay.op2(read(spark, sf_dir, "documents"))


def mixing_query(spark, sf_dir):
    return mixing.op5(read(spark, sf_dir, "documents"))


def decontamination_query(spark, sf_dir):
    return decontam.op9(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def quality_query(spark, sf_dir):
    return quality.op10(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def html_query(spark, sf_dir):
    return html_extract.op1(read(spark, sf_dir, "pages"))


def license_query(spark, sf_dir):
    return license_scan.op4(read(spark, sf_dir, "documents"))


def nearest_query(spark, sf_dir):
    return hnsw.op3(read(spark, sf_dir, "embeddings"))


def pii_query(spark, sf_dir):
    return pii_crf.op6(read(spark, sf_dir, "documents"))


def secret_query(spark, sf_dir):
    return secret_ledger.op8(read(spark, sf_dir, "documents"))


def line_query(spark, sf_dir):
    return line_dedup.op7(read(spark, sf_dir, "documents"))


def run_query(spark, sf_dir):
    return word_runs.op11(read(spark, sf_dir, "documents"))


def code_query(spark, sf_dir):
    return vector_codes.op12(read(spark, sf_dir, "embeddings"))


def minhash_query(spark, sf_dir):
    return minhash_join.op13(read(spark, sf_dir, "documents"))


# Lines of 30 characters and more within two edits, and of 12 and more within one, are linked by brute force. The function counts bytes, so letters of two bytes
# in these tables are first replaced by control characters.
LINES_SQL = """
with recursive raw as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
l as (select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as line from raw where text is not null),
solid as (select * from l where trim(line, ' ' || chr(9) || chr(13)) <> ''),
d as (select line, min((doc_id, pos)) as first_at from solid group by line),
flat as (select line, length(line) as n, translate(line, 'äöüßéèêçáíóñÄÖÜÉÈÊÇÁÍÓÑúÚ©·', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(11)||chr(12)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)||chr(24)||chr(25)||chr(26)||chr(27)||chr(28)||chr(29)||chr(30)) as t from d where length(line) >= 12),
link as (select a.line as a, b.line as b from flat a join (select *, unnest([-2, -1, 0, 1, 2]) as shift from flat) b on a.n = b.n + b.shift and a.line <> b.line
 where levenshtein(a.t, b.t) <= case when least(a.n, b.n) >= 30 then 2 else 1 end),
reach as (select a as node, a as other from link union select r.node, k.b from reach r join link k on r.other = k.a),
near as (select r.node as line, min(d.first_at) as first_at from reach r join d on d.line = r.other group by r.node),
final as (select d.line, coalesce(n.first_at, d.first_at) as first_at from d left join near n on n.line = d.line),
kept as (select l.doc_id, l.pos, l.line, f.line is not null and (l.doc_id, l.pos) > f.first_at as gone from l left join final f on f.line = l.line),
texts as (select doc_id, count(*) filter (gone) as n_removed, string_agg(line, chr(10) order by pos) filter (not gone) as kept from kept group by doc_id)
select raw.doc_id, case when raw.text is null then 0 else len(raw.parts) end as n_lines, coalesce(t.n_removed, 0) as n_removed,
 length(coalesce(t.kept, '')) as n_chars_kept, sha256(coalesce(t.kept, '')) as kept_sha256
from raw left join texts t on t.doc_id = raw.doc_id
"""

# Stretches of equal 5-word shingles at the same distance, by brute force; the CRC is worked out bit by bit.
RUNS_SQL = r"""
with crc as (select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
  lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) as h,
 coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
placed as (select doc_id, w, cast(len(w) as bigint) as n, h, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) end as a from crc),
sized as (select *, 1 + (n - a) // (3 + g % 8) as p from placed),
d as materialized (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) else w end as w from sized),
grams as materialized (select doc_id, n, i, array_to_string(w[i + 1 : i + 5], ' ') as gram from (select *, unnest(range(n - 4)) as i from d where n > 4)),
pairs as (select x.doc_id, x.i, y.i - x.i as q from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
stretches as (select doc_id, q, min(i) as start, count(*) + 4 + q as length from islands group by doc_id, q, island),
runs as materialized (select doc_id, start, length, min(q) as period from stretches where length >= greatest(6, 4 * q) group by doc_id, start, length),
listed as (select doc_id, count(*) as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as listed from runs group by doc_id),
best as (select * from runs qualify row_number() over (partition by doc_id order by length / period desc, start, period) = 1),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select t.doc_id, string_agg(t.word, ' ' order by t.i) filter (gone.i is null) as words from (select doc_id, unnest(w) as word, unnest(range(n)) as i from d) t
 left join gone on t.doc_id = gone.doc_id and t.i = gone.i group by t.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256,
 sha256(coalesce(k.words, '')) as collapsed_sha256, d.n as n_words
from d left join listed l on l.doc_id = d.doc_id left join best b on b.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""


def codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Every round as two steps: all distances of all parts, then the floor of each mean."""
    steps = [
        """with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
 where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select vec_id, label, p, list_slice(v, cast(p * len(v) // 8 + 1 as bigint), cast((p + 1) * len(v) // 8 as bigint)) as v from kept, range(8) as parts(p)),
b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as k, v from x qualify row_number() over (partition by p order by vec_id) <= 16)"""
    ]
    for r in range(rounds + 1):
        gap = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))"
        steps.append(f"""a{r} as materialized (select vec_id, label, p, v, min(e) as e, arg_min(k, (e, k)) as k from
 (select x.*, b.k, cast({gap} as bigint) as e from x join b{r} b on x.p = b.p) group by all)""")
        if r < rounds:
            steps.append(f"""m{r} as (select p, k, pos, cast(sum(c) as bigint) as s, count(*) as n from (select p, k, unnest(v) as c, unnest(range(len(v))) as pos from a{r}) group by p, k, pos),
l{r} as (select p, k, list((s - ((s % n) + n) % n) // n order by pos) as v from m{r} group by p, k),
b{r + 1} as materialized (select b.p, b.k, coalesce(l.v, b.v) as v from b{r} b left join l{r} l on l.p = b.p and l.k = b.k)""")
    last = f"""
, book as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) as h from b{rounds}),
coded as (select vec_id, label, string_agg(printf('%02x', cast(k as integer)), '' order by p) as code, cast(sum(e) as bigint) as error from a{rounds} group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from coded, book"""
    return ",\n".join(steps) + last


# Shared shingles of all pairs of documents, counted.
SHINGLES_SQL = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') as shingle from (select doc_id, w, unnest(range(greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
link as materialized (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select a as node, a as other from link union select r.node, k.b from reach r join link k on r.other = k.a),
least as (select node, min(other) as component_id from reach group by node)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least.component_id, w.doc_id) as component_id, coalesce(least.component_id, w.doc_id) = w.doc_id as kept
from w left join n on n.doc_id = w.doc_id left join least on node = w.doc_id
"""

QUERIES = {
    "op1_html": (html_query, None),
    "op2_simhash_golay": (simhash_query, None),
    "op3_hnsw": (nearest_query, None),
    "op4_licenses": (license_query, None),
    "op5_mix_sources": (mixing_query, None),
    "op6_pii_crf": (pii_query, None),
    "op7_line_dedup": (line_query, LINES_SQL),
    "op8_secret_ledger": (secret_query, None),
    "op9_decontaminate": (decontamination_query, None),
    "op10_quality": (quality_query, None),
    "op11_word_runs": (run_query, RUNS_SQL),
    "op12_vector_codes": (code_query, codes_sql()),
    "op13_minhash_join": (minhash_query, SHINGLES_SQL),
}
