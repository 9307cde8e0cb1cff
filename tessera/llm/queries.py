"""Registered queries of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, decontaminate, exact_dedup, langid, near_dedup, periodic_runs, quality_rules, secret_scan, suffix_dedup
from . import token_counts, token_files, vector_codes
from .tables import shared_folder, table
from .words import words


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole documents, by the vocabulary byte_bpe_50k.json. Nulls, repeats and
    empty tables: as in the operator."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of whole documents and of what they decode to. Nulls, repeats and
    empty tables: as in the operator."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe_codec.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents alike to 85 per cent; kept if the row names its group. Nulls, repeats and
    empty tables: as in the operator."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("kept"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 80 per cent of a benchmark item, with the counts. Nulls, repeats and
    empty tables: as in the operator."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those that aren't held out. Nulls, repeats and
    empty tables: as in the operator."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of whole documents: counts and spans of the base kinds, all spans. Nulls, repeats and
    empty tables: as in the operator."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *map(number, base),
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, sizes and checksums of documents, read back from token files. Nulls, repeats and
    empty tables: as in the operator."""
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    shards = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return token_files.read_token_files(spark, shards, with_ids=False).drop("ids")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents. Nulls, repeats and
    empty tables: as in the operator."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents after repeats of earlier ones are cut. Nulls, repeats and
    empty tables: as in the operator."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), settle=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and learned texts read back from formatted conversations. Nulls, repeats and
    empty tables: as in the operator."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat_format.format_conversations(rows)
    # The formatted text is read back once and its length carried along.
    back = chat_format.read_back(formatted.select(F.struct("conv_id", F.length("formatted").cast("long").alias("formatted_chars")).alias("conv"), "formatted", "loss_mask"), key="conv")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("conv.formatted_chars").alias("formatted_chars"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents of equal text, the one that stays, and a digest of
    each text. Null texts are empty and form a group; of repeated rows one
    stays; a null doc_id comes last; an empty table gives no rows."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest="text_sha256")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all sound embeddings by codebooks fitted to them, and their
    errors. Null and non-finite vectors are left out; equal labels, and nulls
    together, share an error; repeated rows are coded each; an empty table gives
    no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    coded = vector_codes.encode(vectors, books, carry=("label",))
    found = vector_codes.with_group_error(coded, "label", "label_error")
    digest = F.sha2(F.lit(",".join(map(str, books.listed()))), 256)
    return found.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a hash of their key, get a
    tail that repeats itself, as op13's contract has it. Null keys and texts
    without words stay as they are."""
    hashed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = hashed.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    sized = chosen.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", source(i).cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, after a tenth of them got a
    repeating tail; the run that repeats most, and digests of all runs and of
    the collapsed text. Null and empty texts have no runs and nulls for the
    best; repeated rows and empty tables pass through; texts are read whole."""
    found = periodic_runs.find_runs(_planted(table(spark, sf_dir, "documents")))
    # Ratios are compared as products; an equal one that comes later doesn't win.
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(more(b, r), r).otherwise(b))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_secret_scans": op6_secret_scans,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}

# All pairs with a common shingle, then labels spread along links.
OP3_SQL = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as s
  from d where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as m from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by x, y
), links as (
  select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * m >= 85 * (p.n + q.n - m)
), reach as (
  select doc_id, doc_id as least from documents
  union
  select links.y, reach.least from reach join links on reach.doc_id = links.x
), least as (
  select doc_id, min(least) as component_id from reach group by doc_id
)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from documents left join n using (doc_id) join least using (doc_id)
"""

# Containment of every item in every document, by joining all shingles.
OP4_SQL = """
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), b as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark
), items as (
  select item_id, least(5, len(w)) as width, unnest(list_distinct([w[i:i + least(5, len(w)) - 1] for i in range(1, len(w) - least(5, len(w)) + 2)])) as s
  from b where len(w) > 0
), sizes as (
  select item_id, count(*) as n from items group by item_id
), held as (
  select distinct doc_id, width, unnest([w[i:i + width - 1] for i in range(1, len(w) - width + 2)]) as s
  from d, (select distinct width from items) as widths where len(w) >= width
), shared as (
  select doc_id, item_id, count(*) as n_shared from held join items using (width, s) group by doc_id, item_id
)
select doc_id, item_id, n_shared, n as n_item_shingles from shared join sizes using (item_id) where 100 * n_shared >= 80 * n
"""

# Thresholds are exact quantiles here; the sketches' are, too, for tables that
# fit their buffers.
OP8_SQL = """
with w as (
  select doc_id, lang, source, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents
), windows as (
  select doc_id, unnest(range(1, len(w) - 6)) as i, unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) as k from w where len(w) >= 8
), twice as (
  select doc_id, unnest(range(i, i + 8)) as i from (select *, count(*) over (partition by doc_id, k) as n from windows) where n > 1
), covered as (
  select doc_id, count(distinct i) as n from twice group by doc_id
), m as (
  select doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(array_to_string(w, ''), '[^\\p{L}\\p{N}]')) as n_marks, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines, coalesce(n, 0) as n_repeat_words
  from w left join covered using (doc_id)
), r as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, (word_chars - n_marks) / greatest(word_chars, 1) as s, n_dup_lines / greatest(n_lines, 1) as d, word_chars / greatest(n_words, 1) as c from m
), own as (
  select lang, source, count(*) as n, count(*) filter (where d > 0) as nd, quantile_disc(s, [0.25, 0.5, 0.75]) as s,
    quantile_disc(d, [0.25, 0.5, 0.75]) filter (where d > 0) as d, quantile_disc(c, [0.1, 0.5, 0.9]) as c from r where not base_failed group by lang, source
), whole as (
  select lang, quantile_disc(s, [0.25, 0.5, 0.75]) as s, quantile_disc(d, [0.25, 0.5, 0.75]) filter (where d > 0) as d, quantile_disc(c, [0.1, 0.5, 0.9]) as c from r where not base_failed group by lang
), q as (
  select own.lang, own.source, whole.s as ws, whole.d as wd, whole.c as wc,
    case when n >= 50 then own.s else whole.s end as qs, case when nd >= 50 then own.d else whole.d end as qd, case when n >= 50 then own.c else whole.c end as qc
  from own join whole on own.lang is not distinct from whole.lang
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(s < qs[2] - greatest(12 * greatest(qs[2] - qs[1], 0.5 * (ws[2] - ws[1])), 0.02)
    or d > qd[2] + 3 * greatest(qd[3] - qd[2], 0.5 * (wd[3] - wd[2]))
    or c > qc[2] + greatest(5 * greatest(qc[3] - qc[2], 0.5 * (wc[3] - wc[2])), 0.25)
    or c < qc[2] - greatest(5 * greatest(qc[2] - qc[1], 0.5 * (wc[2] - wc[1])), 0.25), false) as kept
from r left join q on r.lang is not distinct from q.lang and r.source is not distinct from q.source
"""

# The template's output is measured, not written: 10 characters before the
# role, 1 after it, 13 after the text, and one for each escape.
OP10_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, 24 + length(role) + length(text) + (length(text) - length(replace(text, '\\', '')))
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 as chars
  from c
), told as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss, sum(chars)::bigint as formatted_chars
  from sized group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from told
"""

OP11_SQL = """
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""

# One round assigns every part by comparing it with all entries of its position,
# and takes the floored means.
_OP12_ASSIGNED = """
  select vec_id, part, x, arg_min(entry, (d, entry)) as entry, min(d) as d
  from (select p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from parts p join {books} b using (part))
  group by vec_id, part, x
"""
_OP12_UPDATED = """
  select b.part, b.entry, case when count(s.position) = 0 then any_value(b.y) else list(s.mean order by s.position) end as y
  from {books} b left join (
    select part, entry, position, (sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) as mean
    from (select part, entry, unnest(range(1, len(x) + 1)) as position, unnest(x) as v from {assigned}) group by part, entry, position
  ) s using (part, entry) group by b.part, b.entry
"""
OP12_SQL = f"""
with v as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x)::bigint) as c from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
  select vec_id, part, c[part * (len(c) // 16) + 1:(part + 1) * (len(c) // 16)] as x from v, range(16) as r(part)
), seeds as (
  select vec_id, row_number() over (order by vec_id) - 1 as entry from v order by vec_id limit 64
), books0 as (select part, entry, x as y from parts join seeds using (vec_id)
), assigned0 as ({_OP12_ASSIGNED.format(books="books0")}
), books1 as ({_OP12_UPDATED.format(books="books0", assigned="assigned0")}
), assigned1 as ({_OP12_ASSIGNED.format(books="books1")}
), books2 as ({_OP12_UPDATED.format(books="books1", assigned="assigned1")}
), assigned2 as ({_OP12_ASSIGNED.format(books="books2")}
), coded as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from assigned2 group by vec_id
), told as (
  select sha256(string_agg(array_to_string(y, ','), ',' order by part, entry)) as codebooks_sha256 from books2
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join v using (vec_id), told
"""

ORACLES: dict[str, str] = {
    "op3_near_dedup": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
}
