"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import crc_mod, documents


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import substring

    return substring.deduplicate(documents(spark, sf_dir)).drop("kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import quality_rules

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(documents(spark, sf_dir), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import pu_quality

    shapes = pu_quality.shapes(documents(spark, sf_dir))
    fold = crc_mod(F.col("doc_id"), 4)
    net = pu_quality.fit(shapes, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 2)
    out = shapes.select("doc_id", (fold == 2).alias("held_out"), pu_quality.scored(net, F.col("shape")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import decontamination

    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import pii

    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import toxicity

    docs = documents(spark, sf_dir).select("doc_id", "text")
    fold = crc_mod(F.col("doc_id"), 5)
    model = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 0))
    out = docs.select("doc_id", (fold == 0).alias("held_out"), toxicity.scored(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import warc

    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("valid")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import chat

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    done = chat.formatted(chat.canonical(chat.records(rows.unionByName(extra))))
    back = chat.read_back(done)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyloom.llm import packing

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import minhash

    return minhash.link(documents(spark, sf_dir), k=2, threshold=80)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import filter_audit

    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import html_text

    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import prefix_trie

    return prefix_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_substring, op3_quality_rules, op4_warc, op5_chat, op6_packing, op7_quality, op8_decontamination, op9_pii, op10_minhash, op11_filter_audit, op12_html_text, op13_prefix_trie)
    return {f.__name__: f for f in ops}


_SAID = "<|im_end|><|im_start|>assistant ok"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: CRC-32 of the decimal digits of conv_id, bit by bit; what is summed over a subtree goes by its members' paths.
_CRC = """xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"""
ORACLES = {
    "op13_prefix_trie": f"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
      row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null),
    n as (select conv_id, count(*) as n, {_CRC} % 9 as h, conv_id - conv_id % 5 as base from t group by conv_id),
    m as (select n.*, least(n.h, coalesce(b.n, 0)) as lead from n left join n b on b.conv_id = n.base),
    r as (select m.conv_id, i as depth, role, text from m join t on t.conv_id = m.base and i <= h union all select m.conv_id, lead + i - h, role, text from m join t on t.conv_id = m.conv_id and i > h),
    q as (select conv_id, depth, list({{'r': role, 't': text}}) over (partition by conv_id order by depth) as path, strlen(text) as size from r
      union all select conv_id, 0, [], 0 from m),
    x as (select conv_id, depth, size, depth = max(depth) over (partition by conv_id) as last, min(conv_id) over (partition by depth, path) as node from q),
    y as (select x.*, p.node as parent from x left join x p on p.conv_id = x.conv_id and p.depth = x.depth - 1),
    d as (select node, depth, max(parent) as parent, count(*) as n_convs, max(size) as size, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '') as ends from y group by 1, 2),
    k as (select d.*, (select count(*) from d c where c.parent = d.node and c.depth = d.depth + 1) as n_children from d),
    s as (select distinct a.node, a.depth, b.node as sub, b.depth as sub_depth from x a join x b on a.conv_id = b.conv_id and a.depth <= b.depth),
    f as (select s.node, s.depth, sum((k.n_convs - 1) * k.size) as saved, count(*) filter (where k.n_children = 0) as leaves from s join k on k.node = s.sub and k.depth = s.sub_depth group by 1, 2)
    select k.node as conv_id, k.depth, k.parent as parent_conv_id, n_convs, n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256
    from k join f on f.node = k.node and f.depth = k.depth""",
    "op2_substring": f"""with d as (select doc_id, {_WORDS} as w from documents),
    s as (select doc_id, unnest(range(len(w) - 19)) as i, unnest([array_to_string(w[i + 1:i + 20], ' ') for i in range(len(w) - 19)]) as win from d where len(w) >= 20),
    x as (select doc_id, i, row_number() over (partition by win order by doc_id, i) > 1 as again from s),
    t as (select doc_id, unnest(range(len(w))) as i, unnest(w) as word from d),
    g as (select t.doc_id, t.i, word, max(case when again then x.i end) over (partition by t.doc_id order by t.i rows between 19 preceding and current row) is not null as gone
      from t left join x on x.doc_id = t.doc_id and x.i = t.i),
    n as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from g group by 1)
    select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join n using (doc_id)""",
    "op4_warc": """with p as (select page_id, coalesce(html, '') as html from pages), f as (select *, strlen(html) as size, min(page_id) over (partition by html) as first from p)
    select page_id, size as payload_bytes, sha256(html) as payload_digest, case when size >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
    case when size >= 100 and page_id > first then first end as refers_to from f""",
    "op5_chat": rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1, 0, 'user', '{_SAID}' union all select -1, 1, 'assistant', '{_SAID}'),
    e as (select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as escaped,
      regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') as head from c)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(head) + length(escaped) + 24) as bigint) as formatted_chars from e group by conv_id""",
    "op11_filter_audit": f"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {_WORDS} as w from documents),
    l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1),
    f as (select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as bad,
      [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
       regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) over (partition by text), false)] as fails from d left join l on l.doc_id = d.doc_id),
    g as (select *, list_sum(list_transform(fails, lambda x: x::int)) as n_fails from f),
    c as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
    o as (select [a.c, b.c, e.c, h.c, i.c] as o from c a, c b, c e, c h, c i where len(list_distinct([a.c, b.c, e.c, h.c, i.c])) = 5),
    s as (select o, step, ascii(o[step]) - 64 as pos, list_transform(o[1:step - 1], lambda x: ascii(x) - 64) as before from o, range(1, 6) r(step)),
    j as (select part, array_to_string(o, '') as filter_order, step::int as step, o[step] as f, good, bad, n_fails, fails[pos] as failing,
      len(list_filter(before, lambda b: fails[b])) > 0 as gone from g, s),
    r as (select part, filter_order, step, f, count(*) filter (where not gone and not failing) as kept, count(*) filter (where not gone and failing) as removed,
      count(*) filter (where gone and failing) as redundant, count(*) filter (where failing and n_fails = 1) as unique_fails,
      count(*) filter (where not gone and failing and good) as good_lost, count(*) filter (where not gone and failing and bad) as toxic_lost from j group by all)
    select * exclude (f), cast(sum(removed) over (partition by part, f) as bigint) as shapley from r""",
    "op10_minhash": f"""with recursive d as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
    s as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as sh from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from d where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by 1),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
    l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
    g as (select a as u, b as v from l union all select b, a from l), r(id, c) as (select u, u from g union select r.id, g.v from r join g on g.u = r.c),
    m as (select id, min(c) as c from r group by 1)
    select doc_id, coalesce(n, 0) as n_shingles, coalesce(c, doc_id) as component_id, coalesce(c, doc_id) = doc_id as kept from documents left join n using (doc_id) left join m on id = doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
