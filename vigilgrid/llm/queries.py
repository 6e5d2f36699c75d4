"""Registered queries of this package and their checking SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_root
from . import (
    byte_bpe,
    chat_format,
    importance,
    language_id,
    mixing,
    phrases,
    pivot_topk,
    secret_links,
    simhash,
    token_counts,
    toxicity,
    url_filter,
    vptree,
)
from .common import crc_bucket, stage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at 2 bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    print_ = F.lpad(F.lower(F.hex("w0")), 16, "0")
    return found.select("doc_id", print_.alias("fingerprint"), "component_id")


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    import public_tokenizers

    tokens = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.with_round_trip(docs, tokens, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network that has seen two of three folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.fit(docs.filter(crc_bucket("doc_id", 3) != 1))
    found = language_id.predict(docs, net)
    return found.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that has seen the labels of three of four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket("doc_id", 4) == 2
    model = toxicity.fit(docs.filter(~held_out), table(spark, sf_dir, "labels"), corpus=docs)
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a planted one full of control strings, formatted and read back."""
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    done = chat_format.format_chats(chats)
    turns, learned = chat_format.read_turns("formatted"), chat_format.learned_texts("formatted", "loss")
    read = done.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learned, "").alias("learned"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# The rules of the query.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLES["op8_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES {", ".join(repr(rule) for rule in URL_RULES)}
), fits AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY host, path
      ORDER BY len(string_split(rule_host, '.')) DESC, length(rule_path) DESC) AS rn
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path AND rn = 1
"""

ORACLES["op3_chat_format"] = """
WITH chats AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) t(i)
), marked AS (
  SELECT *, coalesce(lag(role) OVER turns = role, false) AS again,
    replace(replace(replace(replace(text, '&', '&amp;'), '</turn>', '&turn;'), '<more>', '&more;'), '###', '&head;') AS shown,
    replace(replace(replace(replace(replace(role, '&', '&amp;'), '</turn>', '&turn;'), '<more>', '&more;'), '###', '&head;'),
      chr(10), '&line;') AS named
  FROM chats WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown) + CASE WHEN again THEN 6 ELSE length(named) + 6 + 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after two batches: all documents under two tokenizers, then copies deleted and recounts.

    The second batch deletes exact copies and recounts documents without their license lines; it is
    committed twice and counts once.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    counted = stage(token_counts.counted_documents(docs), "token-counts-docs")
    root = f"{staging_root(spark)}/vigilgrid/token-counts-{uuid.uuid4().hex}"
    each = counted.select("doc_id", "source", "lang", "licensed", F.explode("counts").alias("version", "n"))
    inserts = each.select(F.lit("insert").alias("kind"), "doc_id", "source", "lang", "version", F.col("n.before").alias("n_tokens"))
    token_counts.commit_batch(spark, root, 1, inserts)
    gone = token_counts.copies(counted).withColumn("_gone", F.lit(True))
    marked = each.join(gone, "doc_id", "left").filter(F.col("_gone") | F.col("licensed"))
    kind = F.when(F.col("_gone"), "delete").otherwise("revise").alias("kind")
    changes = marked.select(kind, "doc_id", "source", "lang", "version", F.col("n.after").alias("n_tokens"))
    for _ in range(2):
        token_counts.commit_batch(spark, root, 2, changes)
    return token_counts.totals(spark, root)


ORACLES["op9_token_counts"] = r"""
WITH marked AS (
  SELECT source, lang, regexp_replace(coalesce(text, ''), 'Licensed under[^\n]*', '', 'g') AS text,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy
  FROM documents
), counted AS (
  SELECT source, lang, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS w,
    len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]')) AS p
  FROM marked WHERE NOT copy
)
SELECT source, lang, 'words-1' AS version, count(*) AS docs, CAST(sum(w) AS BIGINT) AS tokens FROM counted GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-2', count(*), CAST(sum(p) AS BIGINT) FROM counted GROUP BY source, lang
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled to the square roots of the observed shares of sources, languages and topics."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", "source", "lang", mixing.form_topic(text).alias("topic"),
        F.regexp_count(text, F.lit(token_counts.WORDS)).cast("long").alias("n_tokens"),
    )
    narrow = stage(narrow, "mix-docs")
    kept = mixing.sample(narrow, {d: F.col(d) for d in ("source", "lang", "topic")}, F.col("n_tokens"))
    return kept.withColumn("probability", F.round("probability", 6))


def _mixing_sql(sweeps: int = mixing.MAX_SWEEPS) -> str:
    dims = ("source", "lang", "topic")
    parts = [r"""
docs AS (
  SELECT doc_id, source, lang, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '{') OR contains(text, '();') THEN 'code'
      WHEN contains(text, 'Licensed under') THEN 'notice' WHEN contains(text, '!!') THEN 'shout' ELSE 'prose' END AS topic,
    len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n_tokens
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)
)""", """
cells AS (
  SELECT coalesce(source, '\\N') AS source, coalesce(lang, '\\N') AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens
  FROM docs GROUP BY ALL
)"""]
    for d in dims:
        parts.append(f"t_{d} AS (SELECT {d}, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS share FROM cells GROUP BY {d})")
    parts.append(
        "s0 AS (SELECT c.*, sum(tokens) OVER () AS whole, 1.0::DOUBLE AS factor, "
        + ", ".join(f"t_{d}.share AS t_{d}" for d in dims)
        + " FROM cells c " + " ".join(f"JOIN t_{d} ON c.{d} = t_{d}.{d}" for d in dims) + ")"
    )
    n = 0
    for _ in range(sweeps):
        for d in dims:
            parts.append(
                f"s{n + 1} AS (SELECT * REPLACE (CASE WHEN sum(tokens * factor) OVER (PARTITION BY {d}) > 0 THEN factor * t_{d} * whole "
                f"/ sum(tokens * factor) OVER (PARTITION BY {d}) ELSE factor END AS factor) FROM s{n})"
            )
            n += 1
    parts.append(f"rated AS (SELECT *, least(1.0, factor / max(CASE WHEN tokens > 0 THEN factor END) OVER ()) AS p FROM s{n})")
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) AS probability "
        "FROM docs d JOIN rated r ON coalesce(d.source, '\\N') = r.source AND coalesce(d.lang, '\\N') = r.lang AND d.topic = r.topic "
        "WHERE CAST('0x' || substr(md5('11:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < p"
    )


ORACLES["op10_mixing"] = _mixing_sql()


@query
def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest whole-number inner products for every fiftieth vector, against all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = pivot_topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5, scale=256.0)
    return found.withColumn("score", F.col("score").cast("long"))


ORACLES["op1_pivot_topk"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op6_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector, against all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark texts, and the quarter that is drawn."""
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


# crc32 of a feature: one reduction over its bytes, with the table of the remainders of all bytes.
ORACLES["op11_importance_resampling"] = r"""
WITH texts AS (
  SELECT true AS target, item_id AS id, text FROM benchmark UNION ALL SELECT false, doc_id, text FROM documents
), worded AS (
  SELECT target, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), single AS (
  SELECT target, id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM worded
), feature AS (
  SELECT target, id, word AS f FROM single
  UNION ALL
  SELECT a.target, a.id, a.word || ' ' || b.word FROM single a JOIN single b ON a.target = b.target AND a.id = b.id AND b.i = a.i + 1
), counted AS (
  SELECT target, id, f, count(*) AS n FROM feature GROUP BY ALL
), crc AS (
  SELECT list(list_reduce(list_prepend(x, range(8)), lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY x) AS t
  FROM range(256) r(x)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(h) / 2 AS BIGINT)),
      lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM counted) q, crc
), bucketed AS (
  SELECT target, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), sizes AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE NOT target), 0) AS s, coalesce(sum(n) FILTER (WHERE target), 0) AS t FROM bucketed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain
  FROM sizes
), weights AS (
  SELECT id AS doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight
  FROM bucketed JOIN gains USING (bucket) WHERE NOT target GROUP BY id
), scored AS (
  SELECT d.doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d JOIN worded w ON NOT w.target AND w.id = d.doc_id LEFT JOIN weights g ON g.doc_id = d.doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 25 // 100 AS drawn FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


@query
def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, and the weak parts of credentials that complement others."""
    found = secret_links.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> Column:
        at = secret_links.KINDS.index(kind)
        return F.size(F.filter("base", lambda p: p["kind"] == at)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in secret_links.BASE],
        F.sha2(secret_links.shown(F.col("base")), 256).alias("base_sha256"),
        secret_links.shown(F.col("spans")).alias("spans"),
    )


def _any_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


def _secrets_sql() -> str:
    """Places of all matches one after the other, then the weak ones held against their complements."""
    s, link = secret_links, r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
    patterns = {
        "assign": f"(?:{_any_case(s.NAMES)}){link}{s.VALUE}", "access": s.ACCESS, "hex": s.HEX,
        "login": f"(?:{_any_case(s.LOGINS)}){link}{s.LOGIN_VALUE}", "bare": s.BARE, "endpoint": s.ENDPOINT,
    }
    shapes = ", ".join(f"({i}, '{kind}', '{patterns[kind]}')" for i, kind in enumerate(s.KINDS))
    pairs = ", ".join(f"('{weak}', '{other}')" for weak, others in s.COMPLEMENTS.items() for other in others)
    fit = f"""CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{link}({s.VALUE})$', 1)) >= {s.LEAST_VALUE}
      WHEN 'bare' THEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE true END"""

    def clear(kind: str, *others: str) -> str:
        listed = ", ".join(repr(o) for o in others)
        return (
            f"SELECT * FROM spans a WHERE kind = '{kind}' AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = a.doc_id "
            f"AND o.kind IN ({listed}) AND o.start < a.stop AND a.start < o.stop)"
        )

    return rf"""
WITH RECURSIVE shapes(ord, kind, pattern) AS (
  VALUES {shapes}
), matched AS (
  SELECT doc_id, ord, kind, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), pattern) AS ms FROM documents, shapes
), walk AS (
  SELECT doc_id, ord, kind, text, ms, 0 AS i, 0::BIGINT AS start, 0::BIGINT AS stop FROM matched WHERE len(ms) > 0
  UNION ALL
  SELECT doc_id, ord, kind, text, ms, i + 1, stop + strpos(substr(text, stop + 1), ms[i + 1]) - 1,
    stop + strpos(substr(text, stop + 1), ms[i + 1]) - 1 + length(ms[i + 1])
  FROM walk WHERE i < len(ms)
), spans AS (
  SELECT doc_id, ord, kind, start, stop, len(regexp_extract_all(substr(text, 1, start), '{s.BLANK}')) AS block
  FROM (SELECT *, ms[i] AS m FROM walk WHERE i > 0) WHERE {fit}
), logins AS (
  {clear("login", *s.BASE)}
), parts AS (
  SELECT * FROM spans WHERE kind IN ('assign', 'access', 'hex')
  UNION ALL SELECT * FROM logins
  UNION ALL {clear("bare", *s.BASE)}
    AND NOT EXISTS (SELECT 1 FROM logins l WHERE l.doc_id = a.doc_id AND l.start < a.stop AND a.start < l.stop)
  UNION ALL {clear("endpoint", *s.BASE)}
), complements(weak, other) AS (
  VALUES {pairs}
), reported AS (
  SELECT * FROM parts WHERE ord < {len(s.BASE)}
  UNION ALL
  SELECT * FROM parts p WHERE ord >= {len(s.BASE)} AND EXISTS (
    SELECT 1 FROM parts o JOIN complements c ON c.weak = p.kind AND c.other = o.kind
    WHERE o.doc_id = p.doc_id AND o.block = p.block AND (p.start - o.stop BETWEEN 0 AND {s.REACH} OR o.start - p.stop BETWEEN 0 AND {s.REACH}))
), told AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(s.BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM reported GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)
"""


ORACLES["op12_secret_scans"] = _secrets_sql()


@query
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that occur most often for what their parts lead to expect."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLES["op13_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang
), runs AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM worded, generate_series(1, 5) s(m) WHERE len(w) >= m)
), counted AS (
  SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.f, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head,
    array_to_string(list_slice(string_split(phrase, ' '), k + 1, m), ' ') AS tail
  FROM counted c, generate_series(1, 4) s(k) WHERE m >= 2 AND k < m
), scored AS (
  SELECT cuts.lang, cuts.m, cuts.phrase, cuts.f AS a, k, x.f AS l, y.f AS r, n, 1000::HUGEINT * cuts.f * n // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN totals USING (lang) JOIN counted x ON x.lang = cuts.lang AND x.phrase = head JOIN counted y ON y.lang = cuts.lang AND y.phrase = tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.lang = b.lang AND o.m > b.m AND 100 * o.a >= 100 * b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
