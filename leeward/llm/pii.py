"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans (e-mail, IP, card, phone) are found by pattern and checksum and always stay. High-recall generators
propose more, overlapping spans. What is known about a candidate's format and surroundings becomes a row of
small integer features; the distinct feature rows, weighted by their counts over all documents, train boosted
trees on weak labels: checksums, ranges, number plans and words before the candidate speak for or against it, whether or not
the base patterns find it; most candidates may stay without a label. On the half of
the documents the trees have not seen, the least score at which a kind's labelled candidates are true in
``precision`` of the cases becomes that kind's threshold; candidates beyond it are added, unless their own label is against
them or they touch a base span.

Positions count code points. They come from the lengths of what lies between matches, summed in order, so no
text is moved: only matches are shuffled. Possessive quantifiers and look-behinds keep the patterns linear and without recursion
on very long runs; they match what the plain patterns match.

Null text: empty. Null ids are kept. Rows equal in id and text get the same spans. Without both positives and
negatives there is nothing to train on and nothing is added. No rows give no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leeward.llm.shared import ident, staged

KINDS = ("email", "ip", "card", "phone")
# The base patterns, in the order of KINDS.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# Generators: (kind, pattern). Kind -1 is decided by the number of digits.
GENERATORS = (
    (0, r"(?<![^\x20\x09-\x0D@<>(),;])[^\x20\x09-\x0D@<>(),;]++@[^\x20\x09-\x0D@<>(),;]++"),
    (1, r"(?<![0-9])[0-9]++(?:[.,:][0-9]++){3}"),
    (-1, r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++"),
)
FEATURES = ("kind", "digits", "size", "marks", "bracket", "dots", "before", "after", "check")
# Words shortly before a candidate, and forms of numbers.
_NEAR = r"(?:^|[^\p{L}])(?:%s)[^\p{L}0-9]{0,4}(?:\p{L}{1,12}[^\p{L}0-9]{1,3})?$"
WORDS = (_NEAR % "e-?mail|mail|correo|courriel", _NEAR % "ip|host|server", _NEAR % "card|visa|mastercard|karte|kreditkarte|tarjeta|carte",
         _NEAR % "tel|telefon|telefono|teléfono|téléphone|phone|telephone|call|mobile|mobil|handy|móvil|fax|whatsapp|cell")
COUNTED = _NEAR % "id|no|nr|isbn|issn|order|invoice|account|serial|version|doi"
PLANS = "|".join((
    r"^(?:\+|00)[1-9][0-9]{0,2}[\x20().-]+[0-9]",
    r"^(?:1[\x20.-]{0,2})?\([0-9]{2,5}\)[\x20.-]{0,2}[0-9]{2,4}(?:[\x20.-]?[0-9]{2,5}){1,3}$",
    r"^0[1-9][0-9]{1,4}[\x20.-]{1,2}[0-9]{2,8}(?:[\x20.-][0-9]{2,5}){0,3}$",
    r"^(?:1[\x20.-])?[2-9][0-9]{2}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"))
DATED = r"^(?:[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[.-][0-9]{2}[.-][0-9]{2})(?![0-9])"


def _found(text: Column, pattern: str, tag: int) -> Column:
    """Matches of one pattern as an array of (tag, place, match, gap before it, characters around it)."""
    between = F.split(text, pattern, -1)
    near = lambda i: F.lower(F.substring(between[i], -32, 32))
    # One bit for each kind's words, one for those of counted things; the generators' matches only.
    said = lambda i: sum((near(i).rlike(w).cast("int") * (1 << k) for k, w in enumerate((*WORDS, COUNTED))), F.lit(0))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(
        F.lit(tag).alias("tag"), (said(i) if tag >= len(BASE) else F.lit(0)).alias("said"), i.alias("place"), m.alias("match"), F.length(between[i]).alias("gap"),
        F.substring(between[i], -1, 1).alias("left"), F.substring(between[i + 1], 1, 1).alias("right")))


def _sort_of(char: Column) -> Column:
    return (F.when(char == "", 0).when(char.rlike(r"[\x20\x09-\x0D]"), 1).when(char.rlike("[0-9]"), 2)
            .when(char.rlike("[A-Za-z]"), 3).when(char.rlike(r"[.,;:!?()\[\]|<>\"']"), 4).otherwise(5))


def _weak_label(said: Column, luhn: Column) -> Column:
    """Evidence for (true) or against (false) a candidate, null without any. It doesn't ask which pattern found it."""
    match, kind, number = F.col("match"), F.col("kind"), F.regexp_replace("match", "[^0-9]", "")
    word = lambda k: said.bitwiseAND(1 << k) != 0
    glued = F.col("before").isin(2, 3) | F.col("after").isin(2, 3)
    ranged, even = F.col("check") == 1, match.rlike(r"^[0-9]++(?:\.[0-9]++){3}$")
    email = F.when(match.rlike(r"^[^@]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}[.!?:]*$"), True).when(
        ~match.rlike(r"@[^@]*[.]") | match.rlike("@.*@"), False)
    ip = F.when(~ranged, False).when(even | word(1), True).otherwise(False)
    card = F.when(glued | ~luhn, False).when(number.rlike("^[3-6]") | word(2), True)
    phone = (F.when(glued | even | word(len(WORDS)), False).when(word(3) | match.rlike(PLANS), True)
             .when(match.rlike(r"^[0-9]+$") | match.rlike(DATED), False))
    return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)


def candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """All matches with positions: (id, h, base, kind, start, end, features). ``h`` is a hash of the text."""
    text = F.coalesce(ident(docs, text_column), F.lit(""))
    patterns = [(k, p) for k, p in enumerate(BASE)] + [(len(BASE) + g, p) for g, (_, p) in enumerate(GENERATORS)]
    rows = docs.select(ident(docs, id_column).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # Only texts with a digit or an at sign can match; the others stop here.
    rows = rows.where(F.col("text").rlike("[0-9@]"))
    one = rows.select("id", "h", F.inline(F.concat(*[_found(F.col("text"), p, t) for t, p in patterns])))
    one = one.repartition("id", "h").dropDuplicates(["id", "h", "tag", "place"])
    order = Window.partitionBy("id", "h", "tag").orderBy("place")
    length = F.length("match")
    end = F.sum(F.col("gap").cast("long") + length).over(order)
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    number = F.regexp_replace("match", "[^0-9]", "")
    luhn = F.coalesce(F.call_function("luhn_check", number), F.lit(False))
    called = F.col("match").rlike(r"^(?:\+|00[1-9]|\()")   # 13 to 15 digits can be either
    kind = F.when(F.col("tag") < len(BASE), F.col("tag"))
    for g, (k, _) in enumerate(GENERATORS):
        wanted = F.lit(k) if k >= 0 else (F.when(digits.between(9, 15) & (called | (digits < 13) | ~luhn), 3)
                                          .when(digits.between(13, 19), 2))
        kind = kind.when(F.col("tag") == len(BASE) + g, wanted)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    valid = (F.when(F.col("tag") == 0, True).when(F.col("tag") == 1, F.col("match").rlike(rf"^{part}(?:\.{part}){{3}}$"))
             .when(F.col("tag") == 2, digits.between(13, 19) & F.call_function("luhn_check", number))
             .when(F.col("tag") == 3, digits.between(9, 15)).otherwise(F.col("kind").isNotNull()))
    ranged = F.col("match").rlike(rf"^{part}(?:[.,:]{part}){{3}}$")
    return (one.withColumn("end", end).withColumn("start", F.col("end") - length).withColumn("kind", kind)
            .where(valid)
            .withColumns({"before": _sort_of(F.col("left")), "after": _sort_of(F.col("right")),
                          "check": F.when(F.col("kind") == 1, ranged).when(F.col("kind") == 2, luhn).otherwise(False).cast("int")})
            .select("id", "h", (F.col("tag") < len(BASE)).alias("base"), "kind", "start", "end",
                    F.least(digits, F.lit(20)).alias("digits"), F.least(length, F.lit(40)).alias("size"),
                    F.least(F.length(F.regexp_replace("match", r"[^\x20().,:-]", "")), F.lit(8)).alias("marks"),
                    F.col("match").contains("(").cast("int").alias("bracket"),
                    F.least(F.length(F.regexp_replace("match", "[^.]", "")), F.lit(5)).alias("dots"),
                    "before", "after", "check", F.when(F.col("tag") >= len(BASE), _weak_label(F.col("said"), luhn)).alias("positive")))


def _boosted(table: DataFrame, rounds: int) -> DataFrame:
    """Scores of all distinct feature rows. ``table``: features, ``positive``, ``n``, ``seen`` (used for training)."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    train = vectors.transform(table.where("seen and positive is not null")
                              .select(*FEATURES, F.col("positive").cast("double").alias("label"),
                                      F.col("n").cast("double").alias("weight")))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=3,
                          stepSize=0.3, seed=5).fit(train)
    rows = vectors.transform(table.select(*FEATURES).distinct())
    return trees.transform(rows).select(*FEATURES, vector_to_array("probability")[1].alias("score"))


def find(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", rounds: int = 12,
         precision: float = 0.95) -> DataFrame:
    """Spans of every (id, text hash): (id, h, base, kind, start, end). Added spans have ``base`` false."""
    found = staged(candidates(docs, id_column, text_column), "pii")
    base = found.where("base")
    # A candidate against the base spans of its text, in order of position: the furthest end so far, the next start.
    along = Window.partitionBy("id", "h").orderBy("start")
    marked = (found.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(
                  along.rangeBetween(Window.unboundedPreceding, 0)))
              .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(
                  along.rangeBetween(0, Window.unboundedFollowing)))
              .where("not base")
              .withColumn("touches", (F.coalesce(F.col("reach"), F.lit(-1)) > F.col("start"))
                          | (F.coalesce(F.col("next"), F.col("end")) < F.col("end"))))
    marked = staged(marked.dropDuplicates(["id", "h", "kind", "start", "end"]), "pii-marked")
    table = marked.groupBy(*FEATURES, "positive", (F.pmod(F.xxhash64("h", F.lit(3)), F.lit(2)) == 0).alias("seen")).agg(
        F.count(F.lit(1)).alias("n"))
    table = staged(table, "pii-features")
    sides = {r["positive"] for r in table.where("seen and positive is not null").select("positive").distinct().collect()}
    spans = base.select("id", "h", "base", "kind", "start", "end")
    if sides != {True, False}:
        return spans
    scores = staged(_boosted(table, rounds), "pii-scores")
    held = (table.where("not seen and positive is not null").join(scores, list(FEATURES))
            .groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p")))
    falling = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    least = (held.withColumn("right", F.sum("p").over(falling) / F.sum("n").over(falling))
             .where(F.col("right") >= precision).groupBy("kind").agg(F.min("score").alias("least")))
    added = (marked.where("not touches and coalesce(positive, true)").join(scores, list(FEATURES)).join(least, "kind")
             .where("score >= least").select("id", "h", F.lit(False).alias("base"), "kind", "start", "end"))
    return spans.union(added)


def report(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """Per row of ``docs``: id, base counts by kind, SHA-256 of the base spans, all spans."""
    spans = find(docs, id_column=id_column, text_column=text_column, **settings)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    entry = F.struct("kind", "start", "end", F.concat_ws(":", name, "start", "end").alias("said"))
    per = spans.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when(F.col("base"), entry))).alias("base"),
        F.array_sort(F.collect_list(entry)).alias("all"))
    keys = docs.select(ident(docs, id_column).alias("id"),
                       F.xxhash64(F.coalesce(ident(docs, text_column), F.lit(""))).alias("h"))
    joined = keys.join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: s["said"]), ","), F.lit(""))
    return joined.select(F.col("id").alias(id_column), *[F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in KINDS],
                         F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))


def redact(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", mark: str = "[{}]", **settings) -> DataFrame:
    """``docs`` with every span replaced by its kind. Overlapping spans are merged under the kind that starts first."""
    spans = find(docs, id_column=id_column, text_column=text_column, **settings)
    key = [F.xxhash64(F.coalesce(ident(docs, text_column), F.lit(""))).alias("h")]
    before = Window.partitionBy("id", "h").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("id", "h").orderBy("start", F.desc("end"), "kind")
    merged = (spans.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
              .withColumn("run", F.sum("new").over(run))
              .groupBy("id", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                             F.min_by("kind", F.struct("start", F.negate("end"))).alias("kind")))
    last = F.lag("end", 1, 0).over(Window.partitionBy("id", "h").orderBy("start"))
    name = F.element_at(F.array(*[F.lit(mark.format(k)) for k in KINDS]), F.col("kind") + 1)
    per = merged.withColumn("from", last).groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "from", name.alias("mark")))).alias("s"))
    rows = docs.select(F.struct(*[ident(docs, c) for c in docs.columns]).alias("r"), ident(docs, id_column).alias("id"),
                       ident(docs, text_column).alias("t"), *key)
    joined = rows.join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    kept = F.concat(
        F.array_join(F.transform("s", lambda s: F.concat(F.substring(F.col("t"), s["from"] + 1, s["start"] - s["from"]), s["mark"])), ""),
        F.expr("substring(t, cast(element_at(s, -1).end + 1 as int))"))
    out = F.when(F.col("s").isNull(), F.col("t")).otherwise(kept)
    return joined.select(*[out.alias(c) if c == text_column else F.col(f"r.`{c}`").alias(c) for c in docs.columns])
