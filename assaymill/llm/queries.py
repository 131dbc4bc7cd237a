"""One query per training-data operator, on the whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.suffix import remove_repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.expr("make_valid_utf8(CAST(kept AS STRING))").alias("text"))


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op1_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
    FROM w
), e AS (SELECT doc_id, unnest(g) AS h, len(g) AS n FROM s),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.x
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.toxicity import grade_texts, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), max_train=20000)
    return grade_texts(docs.select("doc_id", "text"), model).drop("text")


def _fold(count: int):
    """The row's fold, from the crc32 of its id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % count


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.language import identify, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(_fold(3) != 1).select("text", "lang"))
    rows = docs.select("doc_id", (_fold(3) == 1).alias("held_out"), "text")
    return identify(rows, model).drop("text")


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "spans")


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), power=0.5, seed=17)


SQL["op10_source_mixing"] = """
WITH n AS (SELECT source AS s, count(*) AS n_rows FROM documents GROUP BY source),
r AS (SELECT s, sqrt(n_rows) / sum(sqrt(n_rows)) OVER () * sum(n_rows) OVER () / n_rows AS rate FROM n),
p AS (SELECT s, CAST(ceil(rate / 16) AS BIGINT) AS pieces, rate / ceil(rate / 16) AS l FROM r),
t AS (SELECT s, pieces, list_transform(range(0, 101), lambda k: exp(k * ln(l) - l - lgamma(k + 1.0))) AS terms FROM p),
c AS (SELECT s, pieces, list_transform(range(1, 102), lambda k: list_sum(terms[1:k])) AS cdf FROM t),
d AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))) AS name FROM documents),
k AS (
    SELECT d.*, CAST(list_sum(list_transform(range(1, pieces + 1), lambda j: len(list_filter(cdf, lambda x:
        x <= CAST('0x' || substr(md5('17:' || j || ':' || name), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS INTEGER) AS copies
    FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.s
), e AS (SELECT *, unnest(range(1, copies + 1)) AS i FROM k)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS replica, md5('order 17:' || i || ':' || name) AS shuffle_key FROM e
"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.decontaminate import find_leaks

    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return find_leaks(docs, items, similarity=0.8).drop("distance")


# Every start of every text that shares a shingle with an item of the window's size, by number or by weight.
SQL["op4_decontamination"] = rf"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
q AS (SELECT ws, row_number() OVER () AS seq, len(ws) AS size, least(len(ws), 5) AS k FROM (SELECT DISTINCT ws FROM i WHERE len(ws) > 0)),
qg AS (SELECT seq, size, k, ws, unnest(range(0, size - k + 1)) AS back FROM q),
qh AS (SELECT seq, size, k, back, array_to_string(ws[back + 1:back + k], ' ') AS h FROM qg),
rw AS (SELECT h, 1.0e0 / count(DISTINCT seq) AS w FROM qh GROUP BY h),
qu AS (SELECT DISTINCT seq, size, k, h FROM qh),
qt AS (SELECT seq, count(*) AS n_item, sum(w) AS w_item FROM qu JOIN rw USING (h) GROUP BY seq),
kk AS (SELECT DISTINCT k FROM q),
d AS (SELECT DISTINCT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
dg AS (SELECT doc_id, k, len(ws) AS n, ws, unnest(range(0, len(ws) - k + 1)) AS pos FROM d JOIN kk ON len(ws) >= k),
dh AS (SELECT doc_id, k, n, pos, array_to_string(ws[pos + 1:pos + k], ' ') AS h FROM dg),
sz AS (SELECT DISTINCT doc_id, dh.k, size, greatest(n - size, 0) AS latest FROM dh JOIN qu ON qu.h = dh.h AND qu.k = dh.k),
st AS (SELECT *, unnest(range(0, latest + 1)) AS start FROM sz),
win AS (
    SELECT DISTINCT st.doc_id, st.size, st.start, dh.h FROM st JOIN dh ON dh.doc_id = st.doc_id AND dh.k = st.k AND dh.pos BETWEEN st.start AND st.start + st.size - st.k
), wt AS (SELECT doc_id, size, start, count(*) AS n_win, sum(coalesce(w, 1.0e0)) AS w_win FROM win LEFT JOIN rw USING (h) GROUP BY ALL),
m AS (
    SELECT doc_id, seq, win.size, start, count(*) AS n_common, sum(w) AS w_common FROM win JOIN qu ON qu.h = win.h AND qu.size = win.size JOIN rw ON rw.h = win.h GROUP BY ALL
), s AS (
    SELECT m.doc_id, m.seq, m.size, m.start, round(greatest(n_common / (n_item + n_win - n_common), w_common / (w_item + w_win - w_common)), 12) AS similarity
    FROM m JOIN qt USING (seq) JOIN wt ON wt.doc_id = m.doc_id AND wt.size = m.size AND wt.start = m.start
), lined AS (
    SELECT DISTINCT sz.doc_id, sz.size, least(greatest(pos - back, 0), latest) AS start FROM sz JOIN dh ON dh.doc_id = sz.doc_id AND dh.k = sz.k JOIN qh ON qh.h = dh.h AND qh.size = sz.size
), b AS (
    SELECT s.doc_id, i.item_id, s.start, s.size, s.similarity, row_number() OVER (PARTITION BY s.doc_id, i.item_id ORDER BY s.similarity DESC, l.start IS NOT NULL DESC, s.start) AS r
    FROM s JOIN q USING (seq) JOIN i ON i.ws = q.ws LEFT JOIN lined l ON l.doc_id = s.doc_id AND l.size = s.size AND l.start = s.start WHERE s.similarity >= 0.8 - 1e-9
)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS first_word, CAST(size AS BIGINT) AS n_words, round(similarity, 9) AS similarity FROM b WHERE r = 1
"""


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.html_template import extract_main

    return extract_main(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


@query
def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.katz import score_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_fold(5) != 1).alias("train"))
    scored = score_texts(docs, "train")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = r"""
WITH w AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
    SELECT part, doc_id, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS bad FROM w
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
    SELECT a.x || b.x || c3.x || d.x || e.x AS filter_order FROM c a, c b, c c3, c d, c e
    WHERE len(list_distinct([a.x, b.x, c3.x, d.x, e.x])) = 5
), r AS (
    SELECT part, filter_order, list_transform(range(1, 6), lambda s: bad[ascii(filter_order[s]) - 64]) AS fails, len(list_filter(bad, lambda b: b)) AS n_bad,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id) CROSS JOIN o
), s AS (SELECT *, coalesce(list_position(fails, true), 6) AS first_fail, unnest(range(1, 6)) AS step FROM r),
a AS (
    SELECT part, filter_order, step, count(*) FILTER (WHERE first_fail > step) AS kept, count(*) FILTER (WHERE first_fail = step) AS removed,
        count(*) FILTER (WHERE fails[step] AND first_fail < step) AS redundant, count(*) FILTER (WHERE fails[step] AND n_bad = 1) AS unique_fails,
        count(*) FILTER (WHERE first_fail = step AND good) AS good_lost, count(*) FILTER (WHERE first_fail = step AND toxic) AS toxic_lost
    FROM s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM a
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.merkle import FIELDS, fold, leaf_of, manifest, siblings_of

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_of(*[lowered if c == "text" else F.col(c) for c in FIELDS])
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered)
    rows = manifest(_table(spark, sf_dir, "documents"), keep={"tampered": other})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    proof = F.sha2(siblings_of(F.col("proof")), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
    SELECT *, coalesce('1' || lang, '0') AS g, string_split(CAST(doc_id AS VARCHAR), '') AS digits,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), h AS (
    SELECT doc_id, g, low, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(digits, lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b:
        list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1))))) % 3 = 0 AS hit,
        list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda x, y: x || y) AS head
    FROM d
), lv AS (
    SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || CASE WHEN hit THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS other
    FROM h
), rk AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM lv
), nd(g, level, i, n, digest) AS (
    SELECT g, 0, r, n, leaf FROM rk
    UNION ALL
    SELECT g, level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM nd WHERE n > 1 GROUP BY g, level, i // 8
), sub AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM nd WHERE n = 1),
un(level, i, n, digest) AS (
    SELECT 0, r, n, subroot FROM sub
    UNION ALL
    SELECT level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM un WHERE n > 1 GROUP BY level, i // 8
), root AS (SELECT digest AS root FROM un WHERE n = 1),
up AS (
    SELECT sub.g, un.level, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < un.i), '') AS l, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > un.i), '') AS rt
    FROM sub JOIN un ON un.n > 1 AND un.i = CAST(floor(sub.r / pow(8, un.level)) AS BIGINT) JOIN un o ON o.level = un.level AND o.i // 8 = un.i // 8 GROUP BY ALL
), low AS (
    SELECT rk.g, rk.r, nd.level, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < nd.i), '') AS l, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > nd.i), '') AS rt
    FROM rk JOIN nd ON nd.g = rk.g AND nd.n > 1 AND nd.i = CAST(floor(rk.r / pow(8, nd.level)) AS BIGINT) JOIN nd o ON o.g = nd.g AND o.level = nd.level AND o.i // 8 = nd.i // 8 GROUP BY ALL
), pr AS (
    SELECT rk.g, rk.r, coalesce(list(l || '|' || rt ORDER BY p), CAST([] AS VARCHAR[])) AS steps FROM rk LEFT JOIN (
        SELECT g, r, level AS p, l, rt FROM low UNION ALL SELECT rk.g, rk.r, 1000 + up.level, l, rt FROM rk JOIN up USING (g)
    ) s ON s.g = rk.g AND s.r = rk.r WHERE s.p IS NOT NULL GROUP BY rk.g, rk.r
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(replace(array_to_string(steps, ''), '|', ''), '')) AS proof_sha256,
    list_reduce(list_prepend(other, coalesce(steps, CAST([] AS VARCHAR[]))), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2))) AS folded_root,
    folded_root = root AS verified
FROM rk JOIN sub USING (g) CROSS JOIN root LEFT JOIN pr ON pr.g = rk.g AND pr.r = rk.r
"""


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaymill.llm.chat import format_chats, loss_text, parse

    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))])).alias("t"),
    )
    probe = probe.select("conv_id", "t.turn", "t.role", F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    turns = parse(F.col("formatted"))
    read = rows.select("conv_id", "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op11_chat_format"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '### ', ''))) // 4
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS coded FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + length(role) + 2 + coded + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
