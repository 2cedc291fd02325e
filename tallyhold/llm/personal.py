"""Personal data: fixed forms, and information-theoretic sanitisation of the terms that reveal them.

The values of the fixed forms are the protected entities.  Corpus counts tell how strongly a term reveals an entity:
of an entity's distinct contexts (REACH characters on both sides), n(e, t) hold the term t, and df(t) of all N documents
do.  The pointwise mutual information log(n(e, t) N / (n(e) df(t))) is compared with the entity's information content
log(N / n(e)): a term with at least LEAST_CONTEXTS such contexts and at least 1 / ALPHA of that content discloses the
entity.  Disclosing terms are reported wherever they occur (``term``) and are generalised in sanitised texts.

Everything is DataFrame functions.  Each regular expression is bound to the start of a run, which finds the same matches
without trying every later start of a long run in vain.

Null texts count as empty and have no spans.  Null ids are an id like any other.  Repeated rows are separate rows with
equal spans; their equal contexts count once.  An empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhold.llm import common

# The forms that every scan must find, as possessive expressions.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*FORMS, "term")
#: What a text must hold for a form to occur; the form is not tried otherwise.
NEEDED = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}

TERM = r"\p{L}{4,}"
REACH = 120
LEAST_CONTEXTS, ALPHA = 3, 1.25
#: Bits of the fixed-size sketch of terms that a scan looks for; terms it lets pass in error are dropped by a join.
SKETCH_BITS = 20


# ---- forms --------------------------------------------------------------------------------------

def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def entity(kind: str, match: Column) -> Column:
    plain = F.lower(match) if kind in ("email", "ip") else F.regexp_replace(match, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), plain)


def pieces(text: Column, form: str) -> tuple[Column, Column]:
    """Matches of a form, and the text before, between, and after them."""
    return F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)


def matches_with_gaps(text: Column, form: str) -> Column:
    """Array of (match, gap before it, gap after it).  Zipped once: a look-up by index would cut the text again each time."""
    found, gaps = pieces(text, form)
    return F.slice(F.arrays_zip(found.alias("match"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after")),
                   F.lit(1), F.size(found))


def rewritten(text: Column, form: str, change) -> Column:
    """The text with ``change`` applied to each match of a form."""
    found, gaps = pieces(text, form)
    return F.array_join(F.zip_with(gaps, F.transform(found, change), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def matches_of(kind: str, text: Column) -> Column:
    """Array of a text's matches of a kind: turn, code points before it since the last match, length, validity, entity, context."""
    def one(m: Column, i: Column) -> Column:
        match, gap, after = m["match"], m["gap"], m["after"]
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("turn"), F.length(gap).alias("gap"), F.length(match).alias("size"),
                        valid(kind, match).alias("valid"), entity(kind, match).alias("entity"),
                        F.substring(gap, -REACH, REACH).alias("before"), F.substring(after, 1, REACH).alias("after"))

    return F.when(text.rlike(NEEDED[kind]), F.transform(matches_with_gaps(text, FORMS[kind]), one))


def located(found: DataFrame, group: list[str]) -> DataFrame:
    """Matches (turn, gap, size) with ``start`` and ``end``: running sums inside each row."""
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*group).orderBy("turn"))
    return found.withColumn("end", so_far).withColumn("start", so_far - F.col("size"))


# ---- disclosing terms ---------------------------------------------------------------------------

def sketch(terms: DataFrame) -> DataFrame:
    """One row: ``bits`` with two places set for each of the hashes in ``terms`` (term)."""
    words = (terms.select(F.explode(F.array(*places(F.col("term")))).alias("class"))
             .groupBy(F.shiftright("class", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(class & 63 AS int)))").alias("bits")))
    every = terms.sparkSession.range(1 << (SKETCH_BITS - 6)).select(F.col("id").cast("int").alias("word"))
    one = (every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
           .groupBy().agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")))
    return common.written(one.select(F.transform("all", lambda x: x["bits"]).alias("bits")), "private-sketch")


def places(term: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(term, 64 - SKETCH_BITS), F.shiftrightunsigned(term, 20).bitwiseAND(F.lit((1 << SKETCH_BITS) - 1))


def term_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))


def with_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``texts`` with ``hits``: the hashes of their terms that may be among ``terms``."""
    def there(h: Column) -> Column:
        one, two = (F.getbit(F.get(F.col("bits"), F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places(h))
        return one & two

    return texts.crossJoin(F.broadcast(sketch(terms))).withColumn("hits", F.filter(term_hashes(F.col("text")), there)).drop("bits")  # one row


def disclosing(texts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(term): hashes of the terms that disclose an entity.  ``occurrences``: (entity, before, after)."""
    contexts = occurrences.select("entity", "before", "after").distinct()
    of_entity = contexts.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= LEAST_CONTEXTS)
    together = (contexts.select("entity", F.explode(term_hashes(F.concat_ws(" ", "before", "after"))).alias("term"))
                .groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= LEAST_CONTEXTS))
    candidates = common.written(together.join(of_entity, "entity"), "private-candidates")
    frequency = texts.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(float(texts.count()))
    information = F.log(n / F.col("n_entity"))
    mutual = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("df")))
    return common.written(candidates.join(frequency, "term").filter((information > 0) & (mutual >= information / ALPHA)).select("term").distinct(),
                          "private-terms")


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, row_key, kind, start, end) of every occurrence of a disclosing term; equal rows share them."""
    # Only texts that hold one of the terms are cut into words.
    hit = with_hits(texts, terms).filter(F.size("hits") > 0)
    sure = hit.select("row_key", F.explode("hits").alias("term")).join(terms, "term", "left_semi").select("row_key").distinct()
    holding = hit.join(common.written(sure, "private-holding"), "row_key", "left_semi").dropDuplicates(["id", "row_key"])
    words = holding.select("id", "row_key", F.posexplode(F.transform(matches_with_gaps(F.col("text"), TERM), lambda w: F.struct(
        F.xxhash64(F.lower(w["match"])).alias("term"), F.length(w["gap"]).alias("gap"), F.length(w["match"]).alias("size")))).alias("turn", "word"))
    placed = located(words.select("id", "row_key", "turn", "word.*"), ["id", "row_key"])
    return placed.join(terms, "term", "left_semi").select("id", "row_key", F.lit(KINDS.index("term")).alias("kind"), "start", "end")


# ---- jobs ---------------------------------------------------------------------------------------

def keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    plain = documents.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.withColumn("row_key", F.xxhash64("text"))


def found_forms(texts: DataFrame) -> DataFrame:
    """(uid, id, row_key, found): all matches of the fixed forms, without the text."""
    kinds = [F.coalesce(matches_of(kind, F.col("text")), F.expr(
        "cast(array() AS array<struct<kind:int,turn:int,gap:int,size:int,valid:boolean,entity:string,before:string,after:string>>)")) for kind in FORMS]
    return common.written(texts.select(F.monotonically_increasing_id().alias("uid"), "id", "row_key", F.concat(*kinds).alias("found")), "private-forms")


def valid_matches(forms: DataFrame) -> DataFrame:
    each = forms.filter(F.size("found") > 0).select("uid", "id", "row_key", F.explode("found").alias("match")).select("uid", "id", "row_key", "match.*")
    return located(each, ["uid", "kind"]).filter("valid")


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the fixed forms and terms, digest of the forms' spans, and all spans."""
    texts = keyed(documents, key, text)
    forms = found_forms(texts)
    matches = common.written(valid_matches(forms).select("uid", "kind", "start", "end", "entity", "before", "after"), "private-matches")
    terms = disclosing(texts, matches)
    extra = term_spans(texts, terms).groupBy("id", "row_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    extra = common.written(extra.withColumnsRenamed({"id": "of_id", "row_key": "of_key"}), "private-extra")
    spans = matches.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    rows = (forms.select("uid", "id", "row_key").join(common.written(spans, "private-spans"), "uid", "left")
            .join(extra, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key")), "left"))
    none = F.expr("cast(array() AS array<struct<kind:int,start:bigint,end:bigint>>)")
    rows = rows.select("id", F.coalesce("spans", none).alias("spans"), F.sort_array(F.coalesce("extra", none)).alias("extra"))

    def shown(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    return rows.select("id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(FORMS)], F.size("extra").cast("long").alias("n_term"),
                       F.sha2(shown(F.col("spans")).cast("binary"), 256).alias("base_sha256"), shown(F.concat("spans", "extra")).alias("spans"))


def without_forms(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with each valid match in a text replaced by its kind, one kind after another."""
    for kind in FORMS:
        changed = rewritten(F.col(text), FORMS[kind], _generalised(kind))
        rows = rows.withColumn(text, F.when(F.col(text).rlike(NEEDED[kind]), changed).otherwise(F.col(text)))
    return rows


def _generalised(kind: str):
    return lambda m: F.when(valid(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m)


def sanitised(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the fixed forms generalised to their kind and disclosing terms to [TERM]; null texts stay null."""
    texts = keyed(documents, key, text)
    matches = common.written(valid_matches(found_forms(texts)).select("entity", "before", "after"), "private-matches")
    terms = disclosing(texts, matches)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    marked = with_hits(documents.select(F.struct(*columns).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
                       .withColumn("uid", F.monotonically_increasing_id()), terms)
    marked = without_forms(marked.withColumnRenamed("text", "clean"), "clean")
    plain = marked.filter(F.size("hits") == 0).select("row", "clean")
    # Which of the hits are terms indeed is settled by a join of the few texts that have some.
    some = common.written(marked.filter(F.size("hits") > 0), "private-some")
    exact = some.select("uid", F.explode("hits").alias("term")).join(terms, "term", "left_semi").groupBy("uid").agg(F.collect_set("term").alias("exact"))
    joined = rewritten(F.col("clean"), TERM, lambda w: F.when(F.array_contains("exact", F.xxhash64(F.lower(w))), F.lit("[TERM]")).otherwise(w))
    rest = some.join(exact, "uid", "left").select("row", F.when(F.col("exact").isNotNull(), joined).otherwise(F.col("clean")).alias("clean"))
    made = plain.union(rest)
    return made.select(*[F.when(F.col("row")[c].isNotNull(), F.col("clean")).alias(c) if c == text else F.col("row")[c].alias(c) for c in documents.columns])


def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    return scan(common.table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
