"""One query for each corpus operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import Scratch, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import sharding

    return sharding.shard(table(spark, sf_dir, "documents"), scratch=Scratch(spark))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "score", "accepted")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import secrets

    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import sentence_dedup

    return sentence_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark)).drop("text_hash", "class_no")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import decontamination

    found = decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    sure = F.filter("leaks", lambda x: ~x.mention)
    mentioned = F.filter("leaks", lambda x: x.mention)
    return found.select("doc_id", (F.size(sure) > 0).alias("leaked"), F.transform(sure, lambda x: x.item_id).alias("items"), F.transform(mentioned, lambda x: x.item_id).alias("mentions"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import ann

    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import toxicity

    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "offending")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import fim

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.digests(fim.transform(docs, scratch=Scratch(spark)).drop("text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scratch=Scratch(spark))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklight.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_license_scans, op3_quality_classifier, op4_secret_scans, op5_substring_dedup, op6_ngram_jaccard_join, op7_benchmark_decontamination, op8_byte_bpe, op9_nearest_neighbours, op10_toxicity, op11_fill_in_middle, op12_whitening, op13_simhash)
}


def license_sql() -> str:
    """The canonical form, whole, by line and by paragraph, and the lookup of its digests, in the other engine's SQL."""
    from tracklight.llm import licenses

    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"lower({text})"
        for old, new in licenses.SPELLINGS:
            out = f"replace({out}, {quoted(old)}, {quoted(new)})"
        out = f"regexp_replace({out}, {quoted(licenses.WRAPPED_LINE)}, {quoted(chr(92) + '1' + licenses.KEPT + ' ' + chr(92) + '2')}, 'g')"
        for line in (licenses.COPYRIGHT_LINE, licenses.TITLE_LINE):
            out = f"regexp_replace({out}, {quoted(line)}, '', 'g')"
        return f"regexp_replace(replace({out}, {quoted(licenses.KEPT)}, 'copyright'), {quoted(licenses.OTHER)}, ' ', 'g')"

    one_line = lambda f: f"trim(regexp_replace({f}, '[ \\n]+', ' ', 'g'))"
    parts = lambda f: f"list_filter(list_transform(regexp_split_to_array({f}, '\\n *\\n'), lambda x: {one_line('x')}), lambda x: x <> '')"
    known = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in licenses.KNOWN)
    return f"""with known as (select license, {form("text")} as form from (values {known}) v(license, text)),
        texts as (select md5({one_line("form")}) as digest, min(form) as form from known where {one_line("form")} <> '' group by 1),
        names as (select distinct md5({one_line("form")}) as digest, license from known),
        pieces as (select digest as whole, len(p) as n, i as at, md5(p[i]) as digest from (select digest, p, unnest(range(1, len(p) + 1)) as i from (select digest, {parts("form")} as p from texts) a) b),
        forms as (select doc_id, row_number() over () as r, {form("coalesce(text, '')")} as form from documents),
        lines as (select distinct r, md5(line) as digest from (select r, trim(unnest(string_split(form, chr(10)))) as line from forms) z where line <> ''),
        own as (select r, i as at, md5(p[i]) as digest from (select r, p, unnest(range(1, len(p) + 1)) as i from (select r, {parts("form")} as p from forms) a) b),
        runs as (select o.r, p.whole from own o join pieces p on p.digest = o.digest group by o.r, p.whole, o.at - p.at having count(distinct p.at) = any_value(p.n)),
        hits as (select r, digest from lines union select r, whole from runs),
        found as (select h.r, string_agg(distinct k.license, ',' order by k.license) as notices from hits h join names k on k.digest = h.digest group by h.r)
        select f.doc_id, md5({one_line("f.form")}) as digest, (select min(license) from names k where k.digest = md5({one_line("f.form")})) as license, coalesce(n.notices, '') as notices
        from forms f left join found n on n.r = f.r"""


#: Lengths and places are in code points there too.
FILL_IN_MIDDLE_SQL = """with texts as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
    drawn as (select doc_id, t, length(t) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from texts),
    cut as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
    parts as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1, n - b) as s from cut)
    select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(case form when 'plain' then t else p || m || s end) as restored_sha256
    from parts"""

ORACLE: dict[str, str] = {"op2_license_scans": license_sql(), "op11_fill_in_middle": FILL_IN_MIDDLE_SQL}
