"""Registered queries of this folder, thin over its operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, chat, decontaminate, dedup, htmltext, lexical, licences, mixing, pii, quality, repair, sharding, tokenorder
from corpusloom.plans.lineage import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenorder.training_order(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(_table(spark, sf_dir, "pages"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs).select("row.doc_id", "source", "slot", "block", "phase")


def op9_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(lexical.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def _records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation of rows in one of four layouts.

    The table has one layout only; two turns of user and assistant are laid out
    as prompt and completion, three with a system turn as an instruction, others
    as from/value or role/content lists.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.col("t.role"), ",")
    named = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system")])
    text = lambda i: F.try_element_at(F.col("t"), F.lit(i))["text"]
    kind = whole.withColumn("k", F.when(roles == "user,assistant", 0).when(roles == "system,user,assistant", 1).when((F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0) & F.forall("t", lambda x: x["role"].isin("user", "assistant", "system")), 2).otherwise(3))
    fields = [
        F.when(F.col("k") == 0, text(1)).alias("prompt"),
        F.when(F.col("k") == 0, text(2)).alias("completion"),
        F.when(F.col("k") == 1, text(1)).alias("system"),
        F.when(F.col("k") == 1, text(2)).alias("instruction"),
        F.when(F.col("k") == 1, text(3)).alias("output"),
        F.when(F.col("k") == 2, F.transform("t", lambda x: F.struct(named[x["role"]].alias("from"), x["text"].alias("value")))).alias("conversations"),
        F.when(F.col("k") == 3, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
    ]
    return kind.select("conv_id", F.struct(*fields).alias("record"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = f"{chat.END}{chat.START}assistant ok"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    made = chat.format_turns(chat.canonical_turns(_records(rows.unionByName(planted)))).select("conv_id", "formatted", "loss")
    read = chat.read_back(made)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults put in by crc32 of ``conv_id:turn``; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations")
    rows = damaged(table)
    edits = stored(repair.find_edits(rows), "edits")
    sha = repair.turn_digests(repair.apply_edits(rows, edits)).select(F.col("conv_id").alias("_s"), "sha256")
    every = table.select("conv_id").distinct()
    got = every.join(edits.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(sha, F.col("conv_id").eqNullSafe(F.col("_s")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_training_order,
        op2_minhash_near_dedup,
        op3_decontaminate,
        op4_pii,
        op5_html_wrappers,
        op6_sampled_splitters,
        op7_licence_scan,
        op8_pfair_mixing,
        op9_anisotropic_ann,
        op10_quality,
        op11_ranked_search,
        op12_chat_format,
        op13_structure_repair,
    )
}

_H = "('0x' || substr(md5({}), 1, 15))::bigint"
ORACLES: dict[str, str] = {
    "op6_sampled_splitters": f"""
with tab as (select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t),
rows as (
  select doc_id, strlen(coalesce(text, ''))::bigint + 8 as size, coalesce(text, '') as body,
    {_H.format("coalesce(text, '')")} as k, {_H.format("doc_id::varchar")} as h from documents),
bytes as (select *, list_transform(list_filter(string_split(regexp_replace(hex(encode(body)), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''), lambda x: ('0x' || x)::bigint) as list from rows),
crc as (select *, xor(list_reduce(list_concat([4294967295::bigint], list), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::bigint) as crc from bytes, tab),
runs as (
  select doc_id, size, crc, sum(size) over (order by k, h, doc_id rows unbounded preceding) - size as before,
    row_number() over (order by k, h, doc_id) - 1 as spot, sum(size) over () as total from crc),
placed as (select *, ((before * 24) // total)::int as shard from runs)
select doc_id, size, crc as text_crc32, 'bytes' as law, shard, (spot - min(spot) over (partition by shard))::bigint as slot, null::int as grown_shard from placed
""",
    "op7_licence_scan": licences.oracle(),
    "op11_ranked_search": lexical.oracle(),
    "op12_chat_format": chat.oracle(),
}
