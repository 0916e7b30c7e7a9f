"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.llm import ann, decontam, langid, licences, linededup, mixing, quality, sharding, simhash, warc
from slopewise.llm.common import LOWER, UPPER
from slopewise.llm.xxh64_sql import xxh64_tables
from slopewise.session import cut, fresh_path, table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score", "measured")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_covered", "coverage", "n_slots")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_place", "places")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = warc.archive_pages(table(spark, sf_dir, "pages"), folder)
    read = cut(warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    warc.remove(folder)
    return read


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = ~quality.held_out(F.col("doc_id"))
    model = quality.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "slot", "shard")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = langid.learnable(F.col("doc_id"))
    found = langid.identify(docs, langid.fit(docs.where(learn)))
    return found.select("doc_id", (~langid.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_permutation_index": op1_permutation_index,
    "op2_template_decontamination": op2_template_decontamination,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_licences": op6_licences,
    "op7_sharding": op7_sharding,
    "op8_language": op8_language,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
}

def _tokens_sql(text: str) -> str:
    """Canonical tokens in a dialect without lookbehind: what Java looks back for is matched, twice where matches may touch."""
    t = text
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\p{{N}})[.,:](\p{{N}})', '\1\2', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '([\p{{Ll}},;:]) (\p{{Lu}}\p{{Ll}})', '\1 ' || chr(1) || '\2', 'g')"
    t = rf"regexp_replace({t}, '\x01(\p{{Lu}}\p{{Ll}}\p{{L}}*)', ' ' || chr(57344) || '\1 ', 'g')"
    t = rf"regexp_replace({t}, '(\p{{N}}) ?(?i:({decontam.UNITS})\b|[%$€£])', '\1 ' || chr(57346) || '\2 ', 'g')"
    t = rf"regexp_replace({t}, '\p{{N}}+', ' ' || chr(57345) || '\0 ', 'g')"
    return rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}\x{{E000}}-\x{{E002}}]+')"


_SLOT = "ord({0}) BETWEEN 57344 AND 57346"
#: Of tokens with marks and values: the template, and the words and values as they are.
_FORMS = f"""list_transform(marked, lambda t: CASE WHEN {_SLOT.format('t')} THEN t[1] ELSE t END) AS template,
                   list_transform(marked, lambda t: translate(t, chr(57344) || chr(57345) || chr(57346), '')) AS plain"""
_PAIR = "doc_id, text, item_id, item_text, n, n_slots"

ORACLE_SQL = {
    "op2_template_decontamination": f"""
        WITH item AS (
            SELECT item_id, text AS item_text, marked, {_FORMS},
                   len(marked) AS n, least(len(marked), {decontam.WIDTH}) AS width, len(list_filter(marked, lambda t: {_SLOT.format('t')})) AS n_slots
            FROM (SELECT DISTINCT item_id, text, {_tokens_sql('text')} AS marked FROM benchmark WHERE text IS NOT NULL) WHERE len(marked) > 0),
        post AS (
            SELECT item_id, item_text, n, n_slots, width, b, array_to_string(plain[b + 1 : b + width], ' ') AS plain,
                   CASE WHEN n >= {decontam.SHORTEST} AND len(list_filter(marked[b + 1 : b + width], lambda t: NOT ({_SLOT.format('t')}))) >= least({decontam.LITERAL}, width)
                        THEN array_to_string(template[b + 1 : b + width], ' ') END AS template
            FROM item, unnest(range(n - width + 1)) AS t(b)),
        doc AS (SELECT doc_id, text, marked, {_FORMS} FROM (SELECT DISTINCT doc_id, text, {_tokens_sql('text')} AS marked FROM documents WHERE text IS NOT NULL)),
        seen AS (
            SELECT doc_id, text, width, p, array_to_string(template[p + 1 : p + width], ' ') AS template, array_to_string(plain[p + 1 : p + width], ' ') AS plain
            FROM doc, (SELECT DISTINCT width FROM item), unnest(range(len(marked) - width + 1)) AS t(p)),
        hit AS (SELECT DISTINCT {_PAIR}, width, p, b FROM seen JOIN post USING (width, template)),
        spot AS (
            SELECT h.doc_id, h.text, h.item_id, h.item_text, h.n, h.n_slots, p, p - b AS diagonal, b, b + k AS spot_at, i.marked[b + k + 1] AS theirs, d.marked[p + k + 1] AS ours
            FROM hit h JOIN item i ON i.item_id IS NOT DISTINCT FROM h.item_id AND i.item_text = h.item_text
            JOIN doc d ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text = h.text, unnest(range(h.width)) AS t(k)),
        vote AS (
            SELECT *, sum(votes) OVER (PARTITION BY {_PAIR}, diagonal, theirs) AS cast_in_all
            FROM (SELECT {_PAIR}, diagonal, theirs, ours, count(DISTINCT spot_at) AS votes FROM spot WHERE ord(theirs) = 57344 GROUP BY ALL)),
        judged AS (
            SELECT s.*, v.votes IS NULL OR 2 * v.votes > v.cast_in_all AS usual
            FROM spot s LEFT JOIN vote v ON v.doc_id IS NOT DISTINCT FROM s.doc_id AND v.text = s.text AND v.item_id IS NOT DISTINCT FROM s.item_id AND v.item_text = s.item_text
                 AND v.diagonal = s.diagonal AND v.theirs = s.theirs AND v.ours = s.ours),
        fair AS (
            SELECT {_PAIR}, p, b FROM judged GROUP BY {_PAIR}, p, b
            HAVING bool_and(theirs = ours OR ord(theirs) = 57346)
                OR (bool_and(usual) AND count(DISTINCT theirs) FILTER (ord(theirs) = 57345) = count(DISTINCT (theirs, ours)) FILTER (ord(theirs) = 57345))),
        start AS (
            SELECT {_PAIR}, b FROM fair
            UNION
            SELECT {_PAIR}, b FROM seen JOIN post USING (width, plain)),
        found AS (SELECT {_PAIR}, count(DISTINCT b + k) AS c FROM start, unnest(range(least(n, {decontam.WIDTH}))) AS t(k) GROUP BY {_PAIR})
        SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_tokens, CAST(c AS BIGINT) AS n_covered, c / n::DOUBLE AS coverage, CAST(n_slots AS BIGINT) AS n_slots
        FROM found WHERE c >= {decontam.COVERAGE} * n
        QUALIFY row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY c / n::DOUBLE DESC, c DESC, n DESC, n_slots DESC) = 1""",
    "op3_mixing": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS w
            FROM d GROUP BY source),
        f AS (
            SELECT *, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE
                        - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS rest,
                   (SELECT sum(w) FROM s) - coalesce(sum(w) OVER b, 0) AS left_w,
                   2.0::DOUBLE * source_size / w AS fills
            FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT min(rest / left_w) AS level FROM f WHERE fills = (SELECT min(fills) FROM f WHERE fills > rest / left_w)
              AND fills > rest / left_w),
        t AS (SELECT source, source_size,
                     CASE WHEN level IS NULL OR fills <= level THEN 2.0::DOUBLE * source_size ELSE level * w END AS target,
                     CAST(round(CASE WHEN level IS NULL OR fills <= level THEN 2.0::DOUBLE * source_size ELSE level * w END) AS BIGINT) AS goal
              FROM f, l),
        n AS (SELECT total, bits, total / pow(2.0, bits) AS block
              FROM (SELECT total, CAST(least(floor(log2(total)), greatest(18, ceil(log2(total / 65536.0::DOUBLE)))) AS INT) AS bits
                    FROM (SELECT CAST(sum(goal) AS DOUBLE) AS total FROM t) WHERE total > 0)),
        share AS (
            SELECT source, (CAST(sum(goal) OVER (ORDER BY source NULLS LAST) AS DOUBLE) - goal) / total AS lo,
                   CAST(sum(goal) OVER (ORDER BY source NULLS LAST) AS DOUBLE) / total AS hi
            FROM t, n),
        point AS (
            SELECT i AS place, list_sum(list_transform(range(bits), lambda j: CAST((i >> CAST(j AS INT)) & 1 AS DOUBLE) * pow(2.0, -1 - j))) AS u
            FROM n, unnest(range(CAST(pow(2, bits) AS BIGINT))) AS r(i)),
        slot AS (
            SELECT source, place, row_number() OVER (PARTITION BY source ORDER BY place) - 1 AS turn
            FROM point JOIN share ON u >= lo AND u < hi),
        block AS (SELECT source, place, floor(turn * block) AS x, floor((turn + 1) * block) AS y FROM slot, n),
        laid AS (SELECT row, d.source, size, source_size, sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS start
                 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0),
        pass AS (SELECT row, source, start + e * source_size AS a, start + e * source_size + size AS b FROM laid, (VALUES (0), (1)) AS v(e)),
        taken AS (
            SELECT row, sum(least(b, y) - greatest(a, x)) AS words, min(place) AS first_place, count(*) AS places
            FROM pass JOIN block ON block.source IS NOT DISTINCT FROM pass.source AND x < b AND y > a GROUP BY row)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken, first_place, coalesce(places, 0) AS places
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (row)""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY n, h) AS first FROM p),
        b AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(h, CAST(5 * g + 1 AS INT), 5) AS INT)) AS parts FROM f)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(flatten(list_transform(parts, lambda v: list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS INT), 1)))), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM b""",
    "op9_simhash": rf"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        gram AS (SELECT doc_id, array_to_string(words[i + 1 : i + 3], ' ') AS s FROM doc, unnest(range(greatest(1, len(words) - 2))) AS t(i) WHERE len(words) > 0),
        {xxh64_tables("gram")},
        print AS (
            SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum(CAST((h >> {j}) & 1 AS INT)) > count(*) THEN {1 << j}::UBIGINT ELSE 0::UBIGINT END" for j in range(64))} AS fp
            FROM hashed GROUP BY doc_id),
        every AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents LEFT JOIN print USING (doc_id)),
        node AS MATERIALIZED (SELECT fp, min(doc_id) AS node FROM every GROUP BY fp),
        link AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM node a JOIN node b ON a.node <> b.node AND bit_count(xor(a.fp, b.fp)) <= 3),
        c(node, component) USING KEY (node) AS (
            SELECT node, node FROM node
            UNION
            SELECT n.node, min(n.component) FROM (SELECT link.b AS node, c.component FROM c JOIN link ON link.a = c.node) n LEFT JOIN recurring.c r ON r.node = n.node WHERE n.component < r.component GROUP BY n.node)
        SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component AS component_id FROM every JOIN node USING (fp) JOIN c USING (node)""",
    "op10_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        exploded AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM exploded),
        common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) >= 5),
        marked AS (SELECT keyed.*, common.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
