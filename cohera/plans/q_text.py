"""Text-table audits (X rows). All run over whole texts of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohera.functions.text import normalise_title
from cohera.operators import textaudit as X
from cohera.operators.titles import best_matches
from cohera.plans.base import query, rnd, table
from cohera.plans.data import r


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EM, PA = lit(X.EMAIL_PATTERN), lit(X.PATH_PATTERN)


@query(
    "redact_text__X1",
    f"SELECT doc_id, md5(regexp_replace(regexp_replace(text,{PA},'<REDACTED_PATH>','g'),{EM},'<REDACTED_EMAIL>','g')) AS digest, len(regexp_extract_all(text,{PA}))::INTEGER AS n_path, len(regexp_extract_all(text,{EM}))::INTEGER AS n_mail FROM documents",
)
def redact_text(spark, sf):
    o = X.redact(table(spark, sf, "documents"), "text")
    return o.select("doc_id", F.md5("redacted").alias("digest"), "n_path", "n_mail")


PATS = {"absolute user path": X.PATH_PATTERN, "e-mail": X.EMAIL_PATTERN, **X.CREDENTIALS}


@query("scan_findings__X2", " UNION ALL ".join(f"SELECT doc_id, {lit(n)} AS label, unnest(regexp_extract_all(text,{lit(p)})) AS match FROM documents" for n, p in PATS.items()))
def scan_findings(spark, sf):
    return X.scan(table(spark, sf, "documents"), "doc_id", "text")


def _sent_sql():
    t = f"trim(regexp_replace(text,{lit(X.BLANKS)},' ','g'))"
    for a in X.NO_SPLIT:
        t = f"replace({t},{lit(a)},replace({lit(a)},'.',chr(1)))"
    t = f"regexp_replace({t},'([0-9])\\.([0-9])','\\1'||chr(1)||'\\2','g')"
    t = f"regexp_replace({t},'([.?!]) +([A-Z(\\[])','\\1'||chr(2)||'\\2','g')"
    return f"list_filter(list_transform(string_split({t},chr(2)), lambda s: trim(replace(s,chr(1),'.'))), lambda s: s<>'')"


WC = f"len(regexp_extract_all({{0}},{lit(X.WORD)}))"


@query(
    "sentence_report__X3",
    f"SELECT doc_id, {WC.format('text')}::INTEGER AS n_words, len(s)::INTEGER AS n_sentences, len(list_filter(s, lambda x: {WC.format('x')}>45))::INTEGER AS n_long FROM (SELECT doc_id, text, {_sent_sql()} AS s FROM documents)",
)
def sentence_report(spark, sf):
    return X.sentence_report(table(spark, sf, "documents"), "doc_id", "text")


RULES = {**X.SPELLING, "th(e|at|is)": "a", "des?": "of"}


@query(
    "word_list_lint__X4",
    "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(replace(replace(text,'European Organisation',' '),'Ocean and Land Colour Instrument',' ')),'[^A-Za-z0-9_]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1,2) "
    "SELECT doc_id, word, CASE " + " ".join(f"WHEN regexp_full_match(word,{lit(p)}) THEN {lit(v)}" for p, v in RULES.items()) + " END AS wanted, n FROM c WHERE wanted IS NOT NULL",
)
def word_list_lint(spark, sf):
    return X.lint(table(spark, sf, "documents"), "doc_id", "text", RULES)


def _char_sql():
    src = "(SELECT 'documents' AS src, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations)"
    one = []
    for n, c in X.AUDITED.items():
        one.append(f"SELECT src, {lit(n)} AS character, (length(text)-length(replace(text,{lit(c)},'')))//{len(c)} AS n FROM {src}")
    return "SELECT src, character, count(*) AS n_docs, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(one) + ") WHERE n>0 GROUP BY 1,2"


@query("character_audit__X5", _char_sql())
def character_audit(spark, sf):
    t = None
    for name, col in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        part = table(spark, sf, name).select(F.lit(name).alias("src"), F.col(col).alias("text"))
        t = part if t is None else t.unionByName(part)
    return X.character_audit(t, ["src"], "text")


WK = "unnest(list_transform(list_filter(regexp_extract_all(lower(text),'[a-z]+'), lambda x: length(x)>=2), lambda x: regexp_replace(x,'f+[il]?','','g')))"


@query(
    "word_multiset__X6",
    f"""WITH w AS (SELECT conv_id, role, {WK} AS word FROM conversations), a AS (SELECT conv_id, word, count(*) AS na FROM w WHERE role='user' GROUP BY 1,2), b AS (SELECT conv_id, word, count(*) AS nb FROM w WHERE role='assistant' GROUP BY 1,2)
SELECT conv_id, sum(coalesce(na,0))::BIGINT AS total_a, sum(coalesce(nb,0))::BIGINT AS total_b, sum(greatest(coalesce(na,0)-coalesce(nb,0),0))::BIGINT AS only_a, sum(greatest(coalesce(nb,0)-coalesce(na,0),0))::BIGINT AS only_b FROM a FULL JOIN b USING (conv_id, word) GROUP BY 1""",
)
def word_multiset(spark, sf):
    c = table(spark, sf, "conversations")
    a = X.word_counts(c.where("role='user'"), ["conv_id"], X.word_keys(F.col("text")))
    b = X.word_counts(c.where("role='assistant'"), ["conv_id"], X.word_keys(F.col("text")))
    return X.multiset_difference(a, b, ["conv_id"])


# the rule without lookaround: a token follows the start or a character that no word has, and its end is one, too
_SPLIT = r"(?:^|[^A-Za-z0-9_\\\x{80}-\x{10FFFF}])"
_QUOTE = r"regexp_replace(a,'([+\-])','\\\1','g')"


@query(
    "abbreviation_use__X7",
    rf"""WITH t AS (SELECT doc_id, text, unnest(list_distinct(list_transform(regexp_extract_all(text,'{_SPLIT}([A-Za-z][A-Za-z0-9]*(?:[+\-][A-Za-z0-9]+)*\+?)',1), lambda x: regexp_replace(x,'(?:-[a-z][a-z0-9]*)+$','')))) AS a FROM documents),
c AS (SELECT * FROM t WHERE length(regexp_replace(a,'[^A-Z]','','g'))>=2 AND NOT regexp_matches(a,'^[A-Z][a-z]+[A-Z]?$') AND NOT regexp_matches(a,'[0-9]{{2}}') AND length(a)-length(replace(a,'-',''))<3),
p AS (SELECT doc_id, a, length(regexp_extract(text,'(?s)^(.*?{_SPLIT})'||{_QUOTE}||'(?:-[a-z][a-z0-9]*)*(?:$|[^A-Za-z0-9+\-]|-(?:$|[^A-Za-z0-9]))',1))+1 AS f,
  CASE WHEN regexp_matches(text,'\(\s*'||{_QUOTE}||'(?:$|[^A-Za-z0-9])') THEN length(regexp_extract(text,'(?s)^(.*?)\(\s*'||{_QUOTE}||'(?:$|[^A-Za-z0-9])',1))+1 ELSE 0 END AS d FROM c)
SELECT doc_id, a AS abbreviation, f::INTEGER AS first_use, CASE WHEN d>0 THEN d::INTEGER END AS defined_at, CASE WHEN d=0 THEN 'never defined' WHEN d>f+length(a)+400 THEN 'used before definition' ELSE 'ok' END AS status FROM p""",
)
def abbreviation_use(spark, sf):
    return X.abbreviations(table(spark, sf, "documents"), "doc_id", "text")


NT = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}),'<[^>]+>',' ','g'),'[^a-z0-9]+',' ','g'),'[ ]+',' ','g'))"


@query(
    "fuzzy_title_match__X8",
    f"""WITH t AS (SELECT DISTINCT {NT.format("p_name||' <b>'||p_type||'</b>'")} AS title FROM part), f AS (SELECT DISTINCT {NT.format('p_name')} AS ref FROM part),
j AS (SELECT title, ref, 1.0::DOUBLE-levenshtein(title,ref)::DOUBLE/greatest(length(title),length(ref),1) AS ratio FROM t CROSS JOIN f)
SELECT title, ref, {r('ratio', 9)} AS ratio FROM j WHERE ratio>=0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY title ORDER BY ratio DESC, ref)=1""",
)
def fuzzy_title_match(spark, sf):
    p = table(spark, sf, "part")
    t = p.select(normalise_title(F.concat("p_name", F.lit(" <b>"), "p_type", F.lit("</b>"))).alias("title"))
    return best_matches(t, p.select(normalise_title(F.col("p_name")).alias("ref")), 0.5).withColumn("ratio", rnd("ratio", 9))
