"""Audits over a table of texts (doc_id, text). Every text is read whole; findings are rows or counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns.
PATH_PATTERN = r"[A-Za-z]:[\\/]{1,2}[Uu]sers[\\/]{1,2}[^\s\"'\)\],;]*"
EMAIL_PATTERN = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}"
CREDENTIALS = {
    "AWS access key id": r"\bAKIA[0-9A-Z]{16}\b",
    "GitHub token": r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    "Hugging Face token": r"\bhf_[A-Za-z0-9]{30,}\b",
    "Slack token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    "private key block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned secret": r"(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|password)\b\s*[:=]\s*[\"']?[A-Za-z0-9_\-/+]{16,}",
}
# Fixed words: abbreviations that do not end a sentence.
NO_SPLIT = ["et al.", "e.g.", "i.e.", "Eq.", "Eqs.", "Fig.", "Figs.", "Prop.", "Sect.", "vs.", "cf.", "approx."]
# Fixed words: spelling rules (pattern of a whole word, wanted form).
SPELLING = {
    "realis(e|ed|es|ing|ation)": "realiz...", "summaris(e|ed|es|ing|ation)": "summariz...",
    "normalis(e|ed|es|ing|ation)": "normaliz...", "judgement": "judgment", "analys(e|ed|ing)": "analyz...",
    "behaviour": "behavior", "labelled": "labeled", "modelling": "modeling", "colours?": "color", "coloured": "colored",
    "grey(s|ish)?": "gray", "greyscale": "grayscale", "licence": "license", "centres?": "center", "fibre": "fiber",
    "metres?": "meter", "favour(s|ed|ing|able)?": "favor...", "neighbour(s|ing|hood)?": "neighbor...",
    "catalogu(e|ed|es|ing)": "catalog...", "parameteris(e|ed|es|ing|ation)": "parameteriz...",
    "characteris(e|ed|es|ing|ation)": "characteriz...", "standardis(e|ed|es|ing|ation)": "standardiz...",
    "minimis(e|ed|es|ing|ation)": "minimiz...", "maximis(e|ed|es|ing|ation)": "maximiz...",
    "emphasis(e|ed|es|ing)": "emphasiz...", "recognis(e|ed|es|ing)": "recogniz...",
    "generalis(e|ed|es|ing|ation)": "generaliz...", "modelled": "modeled", "travelled": "traveled",
}
EXEMPT = ["European Organisation", "Ocean and Land Colour Instrument"]
# Dashes, invisible characters and the typed dash.
AUDITED = {
    "typed dash": "--", "em dash": "\u2014", "en dash": "\u2013", "soft hyphen": "\u00ad", "zero-width space": "\u200b",
    "zero-width non-joiner": "\u200c", "zero-width joiner": "\u200d", "left-to-right mark": "\u200e",
    "right-to-left mark": "\u200f", "word joiner": "\u2060", "byte order mark": "\ufeff", "no-break space": "\u00a0",
}
WORD = r"[A-Za-z0-9][A-Za-z0-9'+\-]*"
BLANKS = r"[ \t\n\r\f]+"


def redact(df: DataFrame, text: str, allowed_emails: tuple[str, ...] = ()) -> DataFrame:
    """Replace user paths and e-mails, except allowed addresses; adds ``redacted``, ``n_path``, ``n_mail``."""
    t = F.col(text)
    for i, a in enumerate(allowed_emails):
        t = F.regexp_replace(t, "(?i)(?<![A-Za-z0-9_.+-])" + _quote(a) + r"(?![A-Za-z0-9_.-]*[A-Za-z])", f"\u0001{i}\u0001")
    n_path = F.regexp_count(t, F.lit(PATH_PATTERN))
    t = F.regexp_replace(t, PATH_PATTERN, "<REDACTED_PATH>")
    n_mail = F.regexp_count(t, F.lit(EMAIL_PATTERN))
    t = F.regexp_replace(t, EMAIL_PATTERN, "<REDACTED_EMAIL>")
    for i, a in enumerate(allowed_emails):
        t = F.replace(t, F.lit(f"\u0001{i}\u0001"), F.lit(a))
    return df.withColumns({"redacted": t, "n_path": n_path, "n_mail": n_mail})


def _quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def scan(df: DataFrame, doc: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per finding: doc, label, match."""
    pats = patterns or {"absolute user path": PATH_PATTERN, "e-mail": EMAIL_PATTERN, **CREDENTIALS}
    hits = F.array(*[
        F.struct(F.lit(n).alias("label"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("found")) for n, p in pats.items()])
    rows = df.select(doc, F.explode(F.filter(hits, lambda h: F.size(h["found"]) > 0)).alias("h"))
    return rows.select(doc, F.col("h.label").alias("label"), F.explode("h.found").alias("match"))


def sentence_breaks(no_split: list[str] = NO_SPLIT) -> str:
    """Blanks after an end mark that no abbreviation holds, before a capital or an opening bracket. A decimal point has no
    blank after it, so it is none."""
    held = "|".join(_quote(a) for a in no_split)
    return rf"(?<=[.?!])(?<!{held}) +(?=[A-Z(\[])"


def sentences(text: Column) -> Column:
    """Array of sentences; abbreviations and decimals do not end one."""
    found = F.split(F.trim(F.regexp_replace(text, BLANKS, " ")), sentence_breaks())
    return F.filter(found, lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def sentence_report(df: DataFrame, doc: str, text: str, limit: int = 45) -> DataFrame:
    s = df.select(doc, word_count(F.col(text)).alias("n_words"), F.transform(sentences(F.col(text)), word_count).alias("lens"))
    return s.select(doc, "n_words", F.size("lens").alias("n_sentences"), F.size(F.filter("lens", lambda n: n > limit)).alias("n_long"))


def word_counts(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Word multiset per key. Counts are combined on the map side, so a common word is no hot key."""
    return df.select(*keys, F.explode(text).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def lint(df: DataFrame, doc: str, text: str, rules: dict[str, str], exempt: list[str] = EXEMPT) -> DataFrame:
    """Word-list findings: doc, word, wanted, n. Exempt phrases are blanked first. Rules meet distinct words only."""
    t = F.col(text)
    for e in exempt:
        t = F.replace(t, F.lit(e), F.lit(" "))
    # one pass over the text finds the candidate words only; the other words are never split off, exploded or shuffled
    any_rule = "(?<![a-z0-9_])(?:" + "|".join(f"(?:{p})" for p in rules) + ")(?![a-z0-9_])"
    words = F.regexp_extract_all(F.lower(t), F.lit(any_rule), F.lit(0))
    counts = word_counts(df.select(doc, words.alias("_w")), [doc], F.col("_w"))
    wanted = None
    for p, w in rules.items():
        hit = F.col("word").rlike(f"^({p})$")
        wanted = F.when(hit, w) if wanted is None else wanted.when(hit, w)
    return counts.withColumn("wanted", wanted).where(F.col("wanted").isNotNull()).select(doc, "word", "wanted", "n")


def character_audit(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Counts of dashes and invisible characters: keys, character, n_docs, n."""
    items = []
    for name, s in AUDITED.items():
        n = (F.length(text) - F.length(F.replace(F.col(text), F.lit(s), F.lit("")))) / F.lit(len(s))
        items.append(F.struct(F.lit(name).alias("character"), n.cast("long").alias("n")))
    items = F.array(*items)
    rows = df.select(*keys, F.explode(F.filter(items, lambda e: e["n"] > 0)).alias("e"))
    return rows.groupBy(*keys, F.col("e.character").alias("character")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("e.n").cast("long").alias("n"))


def word_keys(text: Column) -> Column:
    """Lower-case words of two letters or more, with f-ligatures removed on both sides."""
    w = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 2)
    return F.transform(w, lambda x: F.regexp_replace(x, "f+[il]?", ""))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a not in b, of b not in a, and totals per key. Inputs: keys, word, n."""
    j = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), [*keys, "word"], "full_outer")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return j.groupBy(*keys).agg(
        F.sum(na).alias("total_a"), F.sum(nb).alias("total_b"), F.sum(F.greatest(na - nb, F.lit(0))).alias("only_a"),
        F.sum(F.greatest(nb - na, F.lit(0))).alias("only_b"))


#: Word characters before a token: ASCII ones, the backslash of a command, and all letters outside ASCII.
BEFORE = r"(?<![A-Za-z0-9_\\]|[^\x00-\x7F])"
TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[+\-][A-Za-z0-9]+)*\+?"
TAIL = r"(?:-[a-z][a-z0-9]*)+$"  # SRF-weighted counts as SRF


def abbreviations(df: DataFrame, doc: str, text: str, slack: int = 400, mixed: tuple[str, ...] = (), allow: tuple[str, ...] = ()) -> DataFrame:
    """First use of each abbreviation against its definition ``(ABC``: ok, used before definition, never defined.

    A token may be hyphenated; lower-case tails are cut. It counts with two capitals or more, or if listed in ``mixed``;
    names such as ``Ab`` or ``AbC``, tokens with two digits in a row or three hyphens, and ``allow`` don't. Positions are
    those of whole tokens (from 1); a definition is the token after an opening bracket, with no letter or digit behind.
    The text of a row is not copied per abbreviation.
    """
    t = F.col(text)
    found = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(BEFORE + f"({TOKEN})"), F.lit(1)), lambda x: F.regexp_replace(x, TAIL, "")))
    capitals = lambda x: F.length(F.regexp_replace(x, "[^A-Z]", "")) >= 2
    listed = (lambda x: x.isin(*mixed)) if mixed else (lambda x: F.lit(False))
    allowed = (lambda x: x.isin(*allow)) if allow else (lambda x: F.lit(False))
    hyphens = lambda x: F.length(x) - F.length(F.replace(x, F.lit("-"), F.lit("")))
    caps = F.filter(found, lambda x: (capitals(x) | listed(x)) & ~allowed(x) & ~x.rlike("^[A-Z][a-z]+[A-Z]?$") & ~x.rlike("[0-9]{2}") & (hyphens(x) < 3))
    quoted = lambda x: F.regexp_replace(x, r"([+\-])", r"\\$1")
    first = lambda x: F.regexp_instr(t, F.concat(F.lit(BEFORE), quoted(x), F.lit(r"(?:-[a-z][a-z0-9]*)*(?![A-Za-z0-9+]|-[A-Za-z0-9])")))
    defined = lambda x: F.regexp_instr(t, F.concat(F.lit(r"\(\s*"), quoted(x), F.lit("(?![A-Za-z0-9])")))
    hits = F.transform(caps, lambda x: F.struct(x.alias("abbreviation"), first(x).alias("first_use"), defined(x).alias("defined")))
    a = df.select(doc, F.inline(hits))
    late = F.col("defined") > F.col("first_use") + F.length("abbreviation") + slack
    status = F.when(F.col("defined") == 0, "never defined").when(late, "used before definition").otherwise("ok")
    return a.select(doc, "abbreviation", "first_use", F.when(F.col("defined") > 0, F.col("defined")).alias("defined_at"), status.alias("status"))
