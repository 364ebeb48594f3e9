"""Secret scans: patterns for known kinds of secrets, and character models that tell random strings from identifiers.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers and words, are trained
from labelled samples: digests in the usual encodings, and identifiers put together from the words of a bounded sample of the
documents themselves and of a small list.  A string of the right alphabet is reported if its log-likelihood ratio is high enough, in all
and per character.  Where a whole run of the alphabet does not pass, its parts that score best are judged alike, so words
that are joined to a secret by / or _ do not hide it.  The models are counts of pairs of characters (a fixed table of 65 x 65 ratios).

A text is worked through in segments, cut where no match can lie across, so time grows as the text does, however long it is
and however many matches it has.  Spans are offsets in code points, found with split() and regexp_extract_all(): matches and the text
between them alternate.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Packed

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_"
_SIZE = len(ALPHABET)
# fixed values: the patterns of the base kinds, in the order that ties are sorted in
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"  # with -, so that a url-safe token is one candidate
_EDGE = 4
KINDS = ("assign", "access", "hex", "random")
_SPANS = "array<struct<start:int,kind:int,end:int>>"
# a character that no pattern holds, or a space between letters or digits, which no match holds, is where a segment may end
_SEGMENT = r"""(?s).{2048,}?(?:[^A-Za-z0-9+/_.=\-"':\x20]|(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9]))|.+"""
#: Documents whose words the sample of identifiers is made from.
SAMPLE_ROWS = 1000

#: Ordinary words that the sample of identifiers is made from.
WORDS = (
    "the of and to in is that for was with this from have are not but had his they one all would there their what out about who get which when make can like time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us value index count buffer request response handler manager service client server config update select insert delete string number object "
    "der die und das ist nicht von mit den sich auch auf werden eine dass haben sein nach wird bei einer noch schon Verwaltung Entwicklung Geschwindigkeit Zusammenarbeit "
    "le les des est une que pas pour dans sur avec sont mais plus comme tout elle nous vous gouvernement administration "
    "el los las una por con para como pero sus hay este desde todo cuando donde quien porque responsabilidad conocimiento"
).split()


def _identifiers(pick, number: Column) -> Column:
    """Six words, pick(0) to pick(5), as identifiers of the usual kinds."""
    many = [pick(k) for k in range(6)]
    return F.array(F.concat(*many), F.array_join(F.array(*many[:4]), "_"), F.concat(many[0], *(F.initcap(w) for w in many[1:5])), F.upper(F.array_join(F.array(*many[:3]), "_")), F.concat(F.initcap(many[0]), many[1], many[2], F.pmod(number, F.lit(100)).cast("string")), F.array_join(F.array(*many[:5]), "/"))


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled strings (text, random): hashes in the usual encodings, and identifiers put together from WORDS."""
    i = F.col("id").cast("string")
    # one digest in three encodings
    digest = F.unhex(F.sha2(F.concat(F.lit("sample "), i), 256))
    base64 = F.translate(F.base64(digest), "=", "")
    strings = F.array(F.substring(F.md5(i), 1, 32), base64, F.translate(base64, "+/", "Qz"), F.translate(base64, "+/", "-_"), F.upper(F.conv(F.substring(F.md5(F.concat(i, F.lit("u"))), 1, 14), 16, 36)))
    words = F.split(F.lit(" ".join(WORDS)), " ")
    names = _identifiers(lambda k: F.get(words, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(WORDS))).cast("int")), F.col("id"))
    r = spark.range(n)
    # a run of one character is rare, but not random
    runs = spark.range(_SIZE * 20).select(F.repeat(F.substring(F.lit(ALPHABET), F.pmod("id", F.lit(_SIZE)).cast("int") + 1, F.lit(1)), 24).alias("text"), F.lit(False).alias("random"))
    return runs.unionAll(r.select(F.explode(strings).alias("text"), F.lit(True).alias("random"))).unionAll(r.select(F.explode(names).alias("text"), F.lit(False).alias("random")))


def corpus_samples(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, words: int = 600) -> DataFrame:
    """Labelled strings (text, random = false) of the documents' own words: identifiers made of runs of six words in a row.

    About ``rows`` distinct texts (those whose hash is low enough; all if there are fewer), and of each up to ``words`` words at places that
    a hash deals over the whole text.  A word is 2 to 15 letters with nothing of the candidates' alphabet around it, so that no secret is taken for one.
    """
    texts = docs.select(F.col(text).cast("string").alias("t")).filter("t is not null")
    bound = min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * rows / max(texts.count(), rows)))
    some = texts.filter(F.xxhash64("t") <= bound).groupBy(F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"))
    found = some.select(F.call_function("regexp_extract_all", F.col("t"), F.lit(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,15}(?![A-Za-z0-9+/_-])"), F.lit(0)).alias("w"), "h")
    found = found.filter(F.size("w") >= 6)
    place = F.explode(F.sequence(F.lit(0), F.least(F.lit(words // 6), F.floor(F.size("w") / 6).cast("int")) - 1)).alias("i")
    at = found.select("w", "h", place).withColumn("at", F.pmod(F.xxhash64("h", "i"), F.size("w") - 5).cast("int"))
    return at.select(F.explode(_identifiers(lambda k: F.get("w", F.col("at") + k), F.col("h"))).alias("text"), F.lit(False).alias("random"))


def _codes(text: Column) -> Column:
    """Places of the characters in ALPHABET, from 0, - as _ (both join words, and url-safe tokens); other characters are left out."""
    places = F.transform(F.split(F.translate(text, "-", "_"), ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    return F.transform(F.filter(places, lambda p: p > 0), lambda p: p - 1)


def train(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log ratios of the two models for each pair of characters, from a table (text, random)."""
    codes = labelled.filter(F.col("text").isNotNull() & F.col("random").isNotNull()).select("random", _codes(F.col("text")).alias("c"))
    pairs = codes.filter(F.size("c") > 1).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.element_at("c", i) * _SIZE + F.element_at("c", i + 1))).alias("pair"))
    counts = {True: [smooth] * (_SIZE * _SIZE), False: [smooth] * (_SIZE * _SIZE)}
    for r in pairs.groupBy("random", "pair").count().collect():  # 2 x 65 x 65 rows at most
        counts[r.random][r.pair] += r["count"]
    row = {k: [sum(v[a * _SIZE : (a + 1) * _SIZE]) for a in range(_SIZE)] for k, v in counts.items()}
    return [math.log(counts[True][p] / row[True][p // _SIZE]) - math.log(counts[False][p] / row[False][p // _SIZE]) for p in range(_SIZE * _SIZE)]


def _table(model: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")


def log_ratio(text: Column, model: list[float]) -> Column:
    """Sum of the log ratios of a string's pairs of characters."""
    table = _table(model)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), F.when(a["last"] < 0, a["sum"]).otherwise(a["sum"] + F.get(table, a["last"] * _SIZE + c)).alias("sum"))
    return F.aggregate(_codes(text), start, step, lambda a: a["sum"])


def random_parts(text: Column, model: list[float], least: float, per_character: float) -> Column:
    """(begin, end) of the parts of a run that pass both limits: the run itself if it does, else the best parts, left to right.

    A running maximum: a part begins anew where its sum falls below 0, and ends at its best place once the sum has fallen by
    ``least`` from there.  A part takes in up to _EDGE characters on either side if they end at a joiner or at the run's end.
    """
    table = _table(model)
    empty = F.array().cast("array<struct<begin:int,end:int>>")
    part = lambda b, e: F.struct(b.cast("int").alias("begin"), e.cast("int").alias("end"))
    n0, f0 = F.lit(0), F.lit(0.0)
    state = lambda last, at, sum_, begin, best, end, whole, parts: F.struct(last.alias("last"), at.alias("at"), sum_.alias("sum"), begin.alias("begin"), best.alias("best"), end.alias("end"), whole.alias("whole"), parts.alias("parts"))
    closed = lambda a: F.when((a["best"] >= least) & (a["best"] >= per_character * (a["end"] - a["begin"])), F.concat(a["parts"], F.array(part(a["begin"], a["end"])))).otherwise(a["parts"])

    def step(a: Column, c: Column) -> Column:
        x = F.when(a["last"] < 0, f0).otherwise(F.get(table, a["last"] * _SIZE + c))
        total = a["sum"] + x
        over = (total < 0) | (total < a["best"] - least)
        better = ~over & (total > a["best"])
        return state(
            c, a["at"] + 1, F.when(over, f0).otherwise(total), F.when(over, a["at"]).otherwise(a["begin"]), F.when(over, f0).otherwise(F.greatest(total, a["best"])),
            F.when(over | better, a["at"] + 1).otherwise(a["end"]), a["whole"] + x, F.when(over, closed(a)).otherwise(a["parts"]))

    n = F.length(text)

    def done(a: Column) -> Column:
        return F.when((a["whole"] >= least) & (a["whole"] >= per_character * n), F.array(part(n0, n))).otherwise(closed(a))

    found = F.aggregate(_codes(text), state(F.lit(-1), n0, f0, n0, f0, n0, f0, empty), step, done)
    before = lambda x: F.length(F.regexp_extract(F.substring(text, F.lit(1), x["begin"]), rf"(?:^|[+/_-])([^+/_-]{{0,{_EDGE}}})$", 1))
    after = lambda x: F.length(F.regexp_extract(F.substring(text, x["end"] + 1, n), rf"^([^+/_-]{{0,{_EDGE}}})(?:$|[+/_-])", 1))
    return F.transform(found, lambda x: part(x["begin"] - before(x), x["end"] + after(x)))


def _spans(text: Column, pattern: str, kind: int, parts) -> Column:
    """Spans of parts(match), an array of (begin, end); matches without parts still use up their text."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.call_function("regexp_extract_all", text, F.lit(pattern), F.lit(0))
    second = F.call_function("regexp_extract_all", text, F.lit(pattern), F.lit(2)) if kind == 0 else whole
    items = F.zip_with(F.zip_with(whole, second, lambda a, b: F.struct(F.length(a).alias("n"), b.alias("s"))), F.slice(between, F.lit(1), F.size(whole)), lambda a, gap: F.struct(a["n"].alias("n"), a["s"].alias("s"), gap.alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(a: Column, m: Column) -> Column:
        begin = a["at"] + m["gap"]
        spans = F.transform(parts(m["s"], m["n"]), lambda x: F.struct((begin + x["begin"]).alias("start"), F.lit(kind).alias("kind"), (begin + x["end"]).alias("end")))
        return F.struct((begin + m["n"]).alias("at"), F.concat(a["spans"], spans).alias("spans"))

    found = F.aggregate(items, start, step, lambda a: a["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _segments(docs: DataFrame, text: str, model: list[float] | None, least: float, per_character: float) -> DataFrame:
    """docs with __segments: array of (text, base spans, random spans) of the segments of each text; offsets are within the segment."""
    if model is None:
        model = train(samples(docs.sparkSession).unionAll(corpus_samples(docs, text)))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    always = lambda s, n: F.array(F.struct(F.lit(0).alias("begin"), n.alias("end")))
    long = lambda s, n: F.when(F.length(s) >= ASSIGN_LENGTH, always(s, n)).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))
    cut = F.call_function("regexp_extract_all", t, F.lit(_SEGMENT), F.lit(0))
    segments = F.when(F.length(t) < 4096, F.array(t)).otherwise(cut)

    def spans(x: Column) -> Column:
        base = F.array_sort(F.concat(_spans(x, ASSIGN, 0, long), _spans(x, ACCESS, 1, always), _spans(x, HEX, 2, always)))
        return F.struct(x.alias("text"), base.alias("base"), _spans(x, CANDIDATE, 3, lambda s, n: random_parts(s, model, least, per_character)).alias("random"))

    def apart(x: Column) -> Column:
        alone = F.filter(x["random"], lambda r: ~F.exists(x["base"], lambda b: (r["start"] < b["end"]) & (b["start"] < r["end"])))
        return F.struct(x["text"].alias("text"), x["base"].alias("base"), F.when(F.size(x["random"]) > 0, alone).otherwise(x["random"]).alias("random"))

    return docs.withColumn("__segments", F.transform(F.transform(segments, spans), apart))


def secret_spans(docs: DataFrame, text: str = "text", model: list[float] | None = None, least: float = 25.0, per_character: float = 1.0) -> DataFrame:
    """docs with __base and __random: arrays of (start, kind as index of KINDS, end), by start and kind.

    Strings that overlap a base span are not reported again.  Null and empty texts have no spans; each row is judged alone.
    Without a model, one is trained from samples() and corpus_samples() of docs.
    """
    found = _segments(docs, text, model, least, per_character)
    # where segments begin: one number each, so a long text's are few
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    begins = F.aggregate("__segments", first, lambda a, x: F.struct((a["at"] + F.length(x["text"])).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    begins = F.when(F.size("__segments") == 1, F.array(F.lit(0))).otherwise(begins)
    found = found.withColumn("__begins", begins)
    shifted = lambda name: F.flatten(F.zip_with("__segments", "__begins", lambda x, at: F.transform(x[name], lambda y: F.struct((y["start"] + at).alias("start"), y["kind"].alias("kind"), (y["end"] + at).alias("end")))))
    return found.withColumn("__base", shifted("base")).withColumn("__random", shifted("random")).drop("__segments", "__begins")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", model: list[float] | None = None, least: float = 25.0, per_character: float = 1.0) -> DataFrame:
    """docs with every span replaced by a mark; spans that overlap become one mark.  Other columns, and null texts, stay as they are."""
    packed = Packed(docs, text)
    found = _segments(packed.rows, "__text", model, least, per_character)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def clean(x: Column) -> Column:
        def step(a: Column, y: Column) -> Column:
            between = F.substring(x["text"], a["at"] + 1, F.greatest(y["start"] - a["at"], F.lit(0)))
            new = F.concat(a["out"], between, F.lit(mark))
            return F.struct(F.when(y["start"] < a["at"], a["out"]).otherwise(new).alias("out"), F.greatest(a["at"], y["end"]).alias("at"))

        spans = F.array_sort(F.concat(x["base"], x["random"]))
        cut = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(x["text"], a["at"] + 1, F.length(x["text"]))))
        return F.when(F.size(x["base"]) + F.size(x["random"]) > 0, cut).otherwise(x["text"])

    return packed.unpack(found, F.when(F.col("__text").isNotNull(), F.array_join(F.transform("__segments", clean), "")))
