"""The registered queries of this subpackage, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from speclake.llm import (
    decontaminate,
    filter_audit,
    line_dedup,
    lm_score,
    main_text,
    pieces,
    quality,
    secrets_scan,
    similar,
    suffix_dedup,
    token_ids,
    turn_repair,
    warc,
)
from speclake.llm.shared import prepared, staged

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = lambda spark, folder: function(prepared(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Words of a text with A-Z lower-cased, and their places from 1.
_SQL_ALNUM = (
    "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op1_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, coalesce({_SQL_ALNUM.format(text='text')}, []) AS w FROM documents),
    b AS (SELECT item_id, {_SQL_ALNUM.format(text='text')} AS w FROM benchmark),
    bw AS (
      SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
        SELECT item_id, w, least(10, len(w)) AS n,
               unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM b WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT n FROM bw),
    dw AS (
      SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
        SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, lengths WHERE len(w) >= n)),
    hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, gram)),
    marked AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
        SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
        SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    report = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return decontaminate.digest(report)


# White-space words of a text; counts of a pattern in a text.
_SQL_WORDS = r"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"
_SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_SQL_LINE_OK = f"""
    {_sql_count('line', quality.NOT_SPACE + '+')} = 0 OR (
      regexp_matches(line, '{quality.SENTENCE.replace("'", "''")}')
      AND {_sql_count('line', quality.SEPARATORS)} * 3 < n
      AND {_sql_count('line', quality.SYMBOLS)} * 2 < n
      AND {_sql_count('line', quality.SHOUT)} * 2 < n
      AND NOT (n <= {quality.STOCK_WORDS}
               AND regexp_matches(line, '(?i)({quality.BOILERPLATE})')))
"""


@query(
    "op7_quality",
    f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, {_SQL_WORDS.format(text='text')} AS w
      FROM documents),
    triples AS (
      SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS gram FROM (
        SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
    repeats AS (
      SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
        SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM triples)
        WHERE c > 1)
      GROUP BY doc_id),
    lines AS (
      SELECT doc_id, line, {_sql_count('line', quality.NOT_SPACE + '+')} AS n FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
    judged AS (
      SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
             coalesce(sum(n) FILTER ({_SQL_LINE_OK}), 0)::BIGINT AS n_clean_words
      FROM lines GROUP BY doc_id),
    counted AS (
      SELECT doc_id, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             {_sql_count('text', quality.SYMBOLS)}::BIGINT AS n_symbols,
             n_dup_lines::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_clean_words
      FROM d JOIN judged USING (doc_id) LEFT JOIN repeats USING (doc_id))
    SELECT *, n_words < {quality.LEAST_WORDS}
              OR 100 * n_repeat_words > {quality.REPEATED} * n_words AS base_failed,
           NOT base_failed AND 100 * (n_words - n_clean_words) <= {quality.LOSS} * n_words AS kept
    FROM counted
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"))


@query("op9_pieces")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    return pieces.encode(table(spark, folder, "documents"), model, digests=True)


@query("op5_token_ids")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids.round_trip(
        table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), end_id=2
    )


@query("op3_secrets")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.scan(table(spark, folder, "documents")))


@query("op4_main_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


@query("op8_line_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.report(table(spark, folder, "documents"))


@query(
    "op2_similar",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_SQL_WORDS.format(text=_SQL_LOWER)} AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {similar.N}
                     THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - {similar.N} + 2),
                            lambda i: array_to_string(w[i:i + {similar.N} - 1], ' '))) END AS s
      FROM d),
    named AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM sets),
    kept AS (SELECT min(doc_id) AS rep, any_value(n) AS n, s FROM named WHERE n > 0 GROUP BY s),
    each AS (SELECT rep, n, unnest(s) AS g FROM kept),
    links AS (
      SELECT a.rep AS x, b.rep AS y FROM each a JOIN each b ON a.g = b.g AND a.rep != b.rep
      GROUP BY a.rep, b.rep, a.n, b.n
      HAVING 100 * count(*) >= {similar.PERCENT} * (a.n + b.n - count(*))),
    reach AS (
      SELECT rep AS x, rep AS y FROM kept
      UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    roots AS (SELECT x AS rep, min(y) AS root FROM reach GROUP BY x)
    SELECT doc_id, named.n::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id
    FROM named LEFT JOIN kept ON named.s = kept.s LEFT JOIN roots USING (rep)
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return similar.classes(table(spark, folder, "documents"), lower=True)


@query("op10_warc")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as WARC records, read back; every revisit with what it stands for."""
    files = staged(warc.history(table(spark, folder, "pages")))
    return warc.digest(warc.resolve(warc.read(files)))


@query(
    "op11_filter_audit",
    rf"""
    WITH w AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             {_SQL_WORDS.format(text='text')} AS w,
             min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
      FROM documents),
    d AS (
      SELECT doc_id, part,
             (len(w) < {filter_audit.LEAST_WORDS})::INT
             + 2 * (100 * len(list_distinct(w)) < {filter_audit.LEAST_DISTINCT} * len(w))::INT
             + 4 * (100 * {_sql_count('text', '[A-Z]')}
                    > {filter_audit.MOST_CAPITALS} * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > least, false)::INT AS mask
      FROM w),
    tags AS (
      SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
      FROM labels GROUP BY doc_id),
    cells AS (
      SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good,
             coalesce(sum(toxic), 0) AS toxic
      FROM d LEFT JOIN tags USING (doc_id) GROUP BY part, mask),
    f AS (SELECT unnest(range(5)) AS f),
    orders AS (
      SELECT [a.f, b.f, c.f, e.f, 10 - a.f - b.f - c.f - e.f] AS o
      FROM f a, f b, f c, f e
      WHERE a.f NOT IN (b.f, c.f, e.f) AND b.f NOT IN (c.f, e.f) AND c.f != e.f),
    steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
    met AS (
      SELECT part, o, n, good, toxic, mask,
             list_min(list_filter(range(1, 6), lambda i: mask & (1 << o[i]) > 0)) AS gone
      FROM cells, orders),
    each AS (
      SELECT m.part, s.o, s.step, s.o[s.step] AS f,
             sum(n) FILTER (gone IS NULL OR gone > s.step) AS kept,
             sum(n) FILTER (gone = s.step) AS removed,
             sum(n) FILTER (gone < s.step AND mask & (1 << s.o[s.step]) > 0) AS redundant,
             sum(n) FILTER (mask = 1 << s.o[s.step]) AS unique_fails,
             sum(good) FILTER (gone = s.step) AS good_lost,
             sum(toxic) FILTER (gone = s.step) AS toxic_lost
      FROM met m JOIN steps s ON m.o = s.o GROUP BY m.part, s.o, s.step)
    SELECT part, array_to_string(list_transform(o, lambda x: chr((65 + x)::INT)), '') AS filter_order,
           step::INT AS step, coalesce(kept, 0)::BIGINT AS kept,
           coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
           coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost,
           coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
    FROM each
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


# crc32 of ASCII text: a table of 256 entries, then one step per character.
_SQL_CRC_TABLE = """
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
"""
_SQL_CRC = """
    xor(4294967295, list_reduce(list_concat([4294967295],
      list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))
"""


@query(
    "op13_turn_repair",
    rf"""
    WITH RECURSIVE crc AS ({_SQL_CRC_TABLE}),
    marked AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_SQL_CRC.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}
             % 20 AS k
      FROM conversations, crc),
    damaged AS (
      SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM marked WHERE k != 0),
    placed AS (
      SELECT *, row_number() OVER (
               PARTITION BY conv_id
               ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i
      FROM damaged),
    faults AS (
      SELECT *, instr('sua', left(role || ' ', 1)) AS ini,
             regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS fin,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen
      FROM placed),
    r AS (
      SELECT *, fin = '' AS blank, fin != '' AND seen AS again,
             fin NOT IN ('', '.', '!', '?') AND NOT seen AS cut, fin = '' OR seen AS go,
             CASE WHEN fin NOT IN ('', '.', '!', '?') THEN 3 ELSE 0 END AS c,
             instr('su ua au', lag(role[1]) OVER w || role[1]) % 3 = 1 AS legal
      FROM faults WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
    sizes AS (
      SELECT conv_id, count(*) AS n, sum(blank::INT) AS blank, sum(again::INT) AS duplicate,
             sum(cut::INT) AS truncated, sum((NOT legal AND i > 1)::INT) AS illegal,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
      FROM r GROUP BY conv_id),
    back AS (
      SELECT conv_id, n + 1 AS i, [0, 6, 3, 0] AS v FROM sizes
      UNION ALL
      SELECT conv_id, i, [least(w[1], 3 + u), least(w[2], 3 + u), u, least(w[4], 3 + w[3])]
      FROM (
        SELECT *, least(w[3], 3 + w[4]) AS u FROM (
          SELECT r.conv_id, r.i, [
              least(4 + v[1], CASE WHEN NOT go AND ini = 1 THEN c + v[2]
                                   WHEN NOT go AND ini = 2 THEN c + v[3] END,
                    CASE WHEN NOT go THEN 3 + c + v[3] END),
              least(4 + v[2], CASE WHEN NOT go THEN (ini != 2)::INT * 3 + c + v[3] END),
              least(4 + v[3], CASE WHEN NOT go THEN (ini != 3)::INT * 3 + c + v[4] END),
              least(4 + v[4], CASE WHEN NOT go THEN (ini != 2)::INT * 3 + c + v[3] END)] AS w
          FROM back b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1))),
    way AS (
      SELECT conv_id, 1::BIGINT AS i, 1 AS s, '' AS letter, NULL::VARCHAR AS line, 0 AS step
      FROM sizes
      UNION ALL
      SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END,
             CASE letter WHEN 'D' THEN s WHEN 'K' THEN kept ELSE forced END, letter,
             CASE letter WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text
                  ELSE CASE forced WHEN 3 THEN 'user:' ELSE 'assistant:' END
                       || CASE letter WHEN 'I' THEN '' ELSE text END END, step + 1
      FROM (
        SELECT *, CASE WHEN here[s] = 4 + after[s] THEN 'D'
                       WHEN here[s] = 3 + here[forced] THEN 'I'
                       WHEN NOT go AND here[s] = c + after[kept] THEN 'K' ELSE 'R' END AS letter
        FROM (
          SELECT w.conv_id, w.i, w.s, w.step, r.role, r.text, r.go, r.c, b.v AS here, e.v AS after,
                 CASE w.s WHEN 3 THEN 4 ELSE 3 END AS forced,
                 CASE WHEN w.s = 1 AND ini = 1 THEN 2 WHEN w.s != 3 AND ini = 2 THEN 3
                      WHEN w.s = 3 AND ini = 3 THEN 4 END AS kept
          FROM way w
          JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i
          LEFT JOIN back e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1
          LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i)
        WHERE after IS NOT NULL OR here[s] > 0)),
    done AS (
      SELECT conv_id, string_agg(letter, '' ORDER BY step) AS audit,
             coalesce(string_agg(line, chr(10) ORDER BY step), '') AS repaired
      FROM way GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1], 0)::BIGINT AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
    LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.report(table(spark, folder, "conversations"))


@query("op12_lm_score")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.report(table(spark, folder, "documents"))
