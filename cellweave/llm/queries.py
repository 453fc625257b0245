"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, quality, quality_rules as rules, toxicity
from .common import held_out, table
from .decontaminate import contaminated_words
from .exact_dedup import exact_duplicates
from .html_text import extract
from .line_dedup import without_boilerplate
from .manifest import manifest
from .passages import without_repeats
from .prefix_trie import prefix_trie
from .quality_rules import judged
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .simhash import near_duplicates
from .url_filter import verdicts

#: CTEs crc_table(t) and, of a decimal number, its unsigned CRC-32 as an expression over that table.
CRC_TABLE = """crc_table as (select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, x)) as crc_t)"""


def crc32_sql(number: str) -> str:
    symbols = f"list_transform(string_split(cast({number} as varchar), ''), lambda s: cast(ascii(s) as bigint))"
    return f"xor(list_reduce({symbols}, lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_exact_dedup", r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.line_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_line_dedup", r"""
with l as (select doc_id, source, md5(text) as page, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as p from documents where text is not null),
t as (select source, count(distinct md5(text)) + max(case when text is null then 1 else 0 end) as pages from documents group by source),
b as (select c.source, c.line from (select source, line, count(distinct page) as n from l where line <> '' group by source, line) c join t on c.source is not distinct from t.source
      where c.n >= 3 and c.n > 0.01 * t.pages),
k as (select doc_id, string_agg(line, chr(10) order by p) as kept_text, count(*) as n from l where not exists (select 1 from b where b.source is not distinct from l.source and b.line = l.line) group by doc_id),
n as (select doc_id, count(*) as n from l group by doc_id)
select d.doc_id, d.source, cast(coalesce(n.n, 0) as bigint) as n_lines, cast(coalesce(n.n, 0) - coalesce(k.n, 0) as bigint) as n_dropped,
       case when d.text is not null then sha256(coalesce(k.kept_text, '')) end as kept_sha256
from documents d left join n on d.doc_id = n.doc_id left join k on d.doc_id = k.doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_benchmark_decontamination", rf"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
iw as (select distinct item_id, least(10, len(w)) as l, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as g
       from i, unnest(generate_series(1, greatest(1, len(w) - 9))) as u(s) where len(w) > 0),
sizes as (select distinct l from iw),
dw as (select doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') as g from d, sizes, unnest(generate_series(1, len(w) - l + 1)) as u(s) where len(w) >= l),
found as (select doc_id, s, l, item_id from dw join iw using (l, g)),
hit as (select doc_id, count(distinct p) as n from found, unnest(generate_series(s, s + l - 1)) as u(p) group by doc_id),
its as (select doc_id, count(*) as n, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
        from (select distinct doc_id, item_id from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit, cast(coalesce(its.n, 0) as bigint) as n_items,
       sha256(coalesce(its.ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join its on d.doc_id = its.doc_id""")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query("op7_substring_dedup", r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, s, array_to_string(w[s:s + 49], ' ') as g from d, unnest(generate_series(1, len(w) - 49)) as u(s) where len(w) >= 50),
f as (select g, min(doc_id) as first_id from g group by g having min(doc_id) < max(doc_id)),
r as (select distinct doc_id, p from g join f using (g), unnest(generate_series(s, s + 49)) as u(p) where first_id < doc_id),
k as (select d.doc_id, string_agg(x, ' ' order by q) as t, count(*) as n
      from (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as q from d) d
      anti join r on d.doc_id = r.doc_id and d.q = r.p group by d.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def quality_rules_sql() -> str:
    stop = ", ".join(f"'{x}'" for w in rules.STOP_WORDS for x in (w, w.capitalize()))
    matches = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    lines = lambda pattern: f"len(list_filter(ls, lambda x: regexp_matches(x, '{pattern}')))"
    held = " and ".join(f"coalesce({r.part} / nullif({r.whole}, 0) between {r.least} and {r.most}, true)" for r in rules.RULES)
    return rf"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{rules.NON_WHITE}+') as w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{rules.NON_WHITE}')) as ls from documents),
g as (select doc_id, s, array_to_string(w[s:s + 2], ' ') as g from w, unnest(generate_series(1, len(w) - 2)) as u(s) where len(w) >= 3),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([s, s + 1, s + 2]) as p from (select *, count(*) over (partition by doc_id, g) as k from g) where k > 1) group by doc_id),
c as (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, {matches(rules.SYMBOL)} as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
      coalesce(r.n, 0) as n_repeat_words, len(ls) as n_lines, len(list_filter(w, lambda x: x in ({stop}))) as n_stop_words, {matches(rules.CAPITAL_WORD)} as n_capital_words,
      {matches(rules.LETTER_WORD)} as n_letter_words, {lines(rules.LIST_LINE)} as n_list_lines, {lines(rules.CUT_LINE)} as n_cut_lines from w left join r on w.doc_id = r.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and {held} as kept from b"""


@query("op11_quality_rules", quality_rules_sql())
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op12_prefix_trie", rf"""
with {CRC_TABLE},
t as (select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w
      from conversations where conv_id is not null),
o as (select conv_id, list(struct_pack(id := id, w := w) order by turn nulls first, id) as a from t group by conv_id),
h as (select conv_id, a, {crc32_sql("conv_id")} % 4 as h from o, crc_table),
f as (select h.conv_id, list_concat(coalesce(o.a[1:h], []), h.a[h + 1:]) as s from h left join o on o.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, d, array_to_string(list_transform(s[1:d], lambda x: x.id), '') as p, case when d > 0 then s[d].w else 0 end as w, len(s) = d as e from f, unnest(generate_series(0, len(s))) as u(d)),
k as (select p, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (e), '')) as ends_sha256 from p group by p, d),
c as (select p[1:32 * (d - 1)] as p, count(*) as n from k where d > 0 group by 1),
n as (select k.*, coalesce(c.n, 0) as n_children from k left join c on k.p = c.p),
below as (select p[1:32 * a] as p, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * w) as saved from n, unnest(generate_series(0, d)) as u(a) group by 1)
select n.conv_id, n.d as depth, up.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves, cast(b.saved as bigint) as saved_tokens, n.ends_sha256
from n join below b on b.p = n.p left join k up on n.d > 0 and up.p = n.p[1:32 * (n.d - 1)]""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def manifest_sql(levels: int = 5) -> str:
    """Levels for up to 16 ** levels rows a source, and as many sources."""
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    digest = lambda text: "sha256(" + " || ".join([*[field(c) for c in ("doc_id", "source", "lang", "n_chars")], field(text)]) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, lowest: str) -> str:
        out = f"{name}0 as ({lowest})"
        for j in range(levels):
            run = "partition by k, pos // 16 order by pos rows between"
            out += f""",
{name}s{j} as (select k, pos, cnt > 1 as step, coalesce(string_agg(dg, '') over ({run} unbounded preceding and 1 preceding), '') as bef,
      coalesce(string_agg(dg, '') over ({run} 1 following and unbounded following), '') as aft from {name}{j}),
{name}{j + 1} as (select k, pos // 16 as pos, (any_value(cnt) + 15) // 16 as cnt, case when any_value(cnt) > 1 then sha256(string_agg(dg, '' order by pos)) else any_value(dg) end as dg
      from {name}{j} group by k, pos // 16)"""
        return out

    def climb(name: str, start: int) -> str:
        out = ""
        for j in range(levels):
            i = start + j
            out += f""",
f{i + 1} as (select f.* exclude (f, proof, k, pos), f.k, f.pos // 16 as pos, case when s.step then sha256(s.bef || f.f || s.aft) else f.f end as f,
      case when s.step then f.proof || s.bef || s.aft else f.proof end as proof from f{i} f join {name}s{j} s on f.k = s.k and f.pos = s.pos)"""
        return out

    return f"""
with {CRC_TABLE},
x as (select coalesce('=' || source, '') as k, doc_id, {digest("text")} as leaf, coalesce({crc32_sql("doc_id")} % 5 = 0, false) as hit, {digest(lowered)} as low from documents, crc_table),
y as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by k) as cnt from x),
{tree("a", "select k, pos, cnt, leaf as dg from y")},
{tree("b", f"select '' as k, row_number() over (order by k) - 1 as pos, count(*) over () as cnt, dg from a{levels}")},
src as (select a.k as source_key, a.dg as subroot, row_number() over (order by a.k) - 1 as source_pos from a{levels} a),
f0 as (select k, k as source_key, pos, doc_id, leaf, case when hit then low else leaf end as f, '' as proof from y){climb("a", 0)},
g as (select f.* exclude (k, pos), '' as k, s.source_pos as pos, s.subroot from f{levels} f join src s on s.source_key = f.source_key),
f{levels + 1} as (select * from g){climb("b", levels + 1)}
select doc_id, leaf, subroot, b.dg as root, sha256(proof) as proof_sha256, f as folded_root, f = b.dg as verified from f{2 * levels + 1}, b{levels} b"""


@query("op13_merkle_manifest", manifest_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
