"""Secrets in texts: candidates by shape, false positives removed by a random forest.

A candidate is a long run of key characters, a value of any length and any characters
behind a credential's name, or the user part of a URL (its password if there is one). A
quoted value goes to the closing quote, any other to the next space or the next name with
its mark, without the marks that close it, so that values together are no longer than the
text. Its features are its length, transitions
between character classes, the share of places at which a word of the corpus begins,
whether it sits in a path, and the words around it. Findings that are labelled beyond
doubt - a value assigned to a credential's name, against plain words, plain numbers and
named digests - train a forest, which then judges every finding. Labels may also be
given. Each finding trains twice: as it is, and without what is around it (``bare``), so
that the forest also learns what secrets look like where no name, digest or issuer tells,
and does more than repeat the rule that made its labels. All of it is DataFrame and MLlib
work.

The corpus dictionary holds the words, of any length, of at least a given share of the
texts (``share``), so it does not depend on the size of the corpus. The size bounded by
a parameter is the labelled findings that train (``sample``, of each label the distinct
ones with the smallest hash). Everything else covers all rows.

Defined results: a null or empty text has no findings; repeated rows have theirs each;
null ids are kept; findings without labels of both kinds to learn from have a null
score and count as secrets. Positions are characters, the end exclusive. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.session import stored

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Characters looked at on both sides of a candidate.
AROUND = 40
NAMES = r"token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer"
CREDENTIAL = rf"(?i)({NAMES})\W{{0,5}}$"
#: A run that holds the name itself, as in ``token=...``.
NAMED_WITHIN = rf"(?i)({NAMES})=+[^=]"
#: Where the next name with its mark begins, an unquoted value ends.
NEXT_NAME = rf"(?:{NAMES})(?:[\"'`)\]}}:=>|]|->)"
#: A credential's name, with what parts it from the value, the value, and what follows.
NAMED_VALUE = (
    rf"(?is)({NAMES})(?=[\s\"'`)\]}}:=>|-])(?=([\"'`)\]}}]{{0,2}}\s*+(?:(?:->|[:=>|]{{1,3}})\s*+)?[\"'`(\[{{<]?)"
    rf"((?<=\")[^\"\n]+(?=\")|(?<=')[^'\n]+(?=')|(?<=`)[^`\n]+(?=`)|(?<=>)(?:(?!{NEXT_NAME})[^<\n])++(?=</)"
    rf"|(?<=[\s\"'`)\]}}:=>|(\[{{<])[^\s\"'`](?:(?!{NEXT_NAME})\S)*+)(.{{0,{AROUND}}}))"
)
#: The same for the user part of a URL.
URL_VALUE = rf"(?is)(://)(?=((?:[^\s/:@\"<>]*:)?+)([^\s/@\"<>][^\s/\"<>]*)(@.{{0,{AROUND}}}))"
#: Marks that close what is around an unquoted value.
CLOSING = ".,;\"'`)]}>"
DIGEST = r"(?i)(sha-?\d*|md5|digest|checksum|commit|revision|etag|uuid|guid|hash)\W{0,5}$"
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|AIza|eyJ)"
SHORTEST_WORD = 3
#: Letters of a word that are joined at once.
PIECE = 12
#: Characters of a value that are cut into pieces at once.
BLOCK = 1_000
FEATURES = [
    "size", "digits", "uppers", "symbols", "class_changes", "case_changes", "vowel_changes", "coverage",
    "in_path", "slashes", "named", "digested", "issued", "quoted", "assigned", "wordy_left", "wordy_right",
]
#: Features that tell what labels are made of, or what is around a finding.
EVIDENCE, SURROUNDINGS = ["named", "digested", "issued", "quoted", "assigned"], ["wordy_left", "wordy_right"]
TREES, DEPTH, SEED = 24, 6, 11


def _runs() -> Column:
    """Runs of key characters, each with the text before it."""
    gaps = F.split("text", CANDIDATE, -1)
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("value"), F.slice(gaps, 2, 1 << 30).alias("after"))
    return F.transform(
        F.filter(found, lambda f: f["value"].isNotNull()),
        lambda f, k: F.struct(
            F.lit(0).alias("kind"), k.alias("k"), (F.length(f["gap"]) + F.length(f["value"])).alias("step"), (-F.length(f["value"])).alias("ahead"), f["value"].alias("value"),
            F.right(f["gap"], F.lit(AROUND)).alias("left"), F.left(f["after"], F.lit(AROUND)).alias("right"),
        ),
    )


def _behind(pattern: str, kind: int) -> Column:
    """Values behind what a pattern reads; its groups are that, the marks between, the value and the rest."""
    parts = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in enumerate(("name", "marks", "value", "rest"), 1)]
    found = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), *parts)

    def one(f: Column, k: Column) -> Column:
        closed = f["marks"].rlike("[\"'`>]$") & (F.left(f["rest"], F.lit(1)) == F.right(f["marks"], F.lit(1))) | f["marks"].rlike(">$") & f["rest"].startswith("</") | F.lit(kind == 2)
        value = F.when(closed, f["value"]).otherwise(F.rtrim(f["value"], F.lit(CLOSING)))
        rest = F.concat(F.substring(f["value"], F.length(value) + 1, F.lit(AROUND)), f["rest"])
        return F.struct(
            F.lit(kind).alias("kind"), k.alias("k"), (F.length(f["gap"]) + F.length(f["name"])).alias("step"), F.length(f["marks"]).alias("ahead"), value.alias("value"),
            F.right(F.concat(f["gap"], f["name"], f["marks"]), F.lit(AROUND)).alias("left"), F.left(rest, F.lit(AROUND)).alias("right"),
        )

    return F.transform(F.filter(found, lambda f: f["value"].isNotNull()), one)


def findings(docs: DataFrame) -> DataFrame:
    """(row, k, doc_id, start, end, value, left, right): every candidate of every text.

    A value behind a name or in a URL is a candidate of its own unless a run contains it.
    """
    ways = [(CANDIDATE, _runs()), (NAMED_VALUE, _behind(NAMED_VALUE, 1)), (URL_VALUE, _behind(URL_VALUE, 2))]
    own = docs.select("doc_id", "text").where(F.greatest(*(F.col("text").rlike(p) for p, _ in ways))).withColumn("row", F.monotonically_increasing_id())
    each = own.select("row", "doc_id", F.explode(F.flatten(F.array_compact(F.array(*(F.when(F.col("text").rlike(p), found) for p, found in ways))))).alias("f")).select("row", "doc_id", "f.*")
    before = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("start", F.sum("step").over(before) + F.col("ahead")).withColumn("end", F.col("start") + F.length("value")).where("value <> ''")
    runs = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("row", "start", "end").orderBy("kind", "k")
    each = each.withColumns({"reach": F.max(F.when(F.col("kind") == 0, F.col("end"))).over(runs), "copy": F.row_number().over(same)})
    each = each.where("kind = 0 OR copy = 1 AND (reach IS NULL OR reach < end)")
    return each.select("row", (F.col("kind").cast("long") * (1 << 40) + F.col("k")).alias("k"), "doc_id", "start", "end", "value", "left", "right")


def dictionary(docs: DataFrame, share: float) -> DataFrame:
    """The words of at least this share of the texts; letters next to digits are no word."""
    own = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    each = docs.select(F.explode(own).alias("word")).where(F.col("word").rlike(rf"^\p{{L}}{{{SHORTEST_WORD},}}$"))
    counted = each.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= share * docs.where("text IS NOT NULL").count()).select("word")


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """(value, covered): the number of places of each distinct value at which a word begins.

    Words of up to PIECE letters are joined as they are, longer ones by their first PIECE
    letters and then compared in full, so the pieces grow with the value's length only.
    """
    values = found.select(F.sha2("value", 256).alias("id"), "value").distinct()
    own, over = (F.regexp_extract_all("value", F.lit(rf"(?s)(.{{1,{BLOCK}}})(?=(.{{0,{PIECE - 1}}}))"), F.lit(g)) for g in (1, 2))
    blocks = values.select("id", F.length("value").alias("size"), F.posexplode(F.arrays_zip(own.alias("own"), over.alias("over"))).alias("b", "f"))
    blocks = blocks.select("id", "size", "b", F.length("f.own").alias("n"), F.concat("f.own", "f.over").alias("text"))
    ahead = F.transform(
        F.sequence(F.lit(1), F.col("n")),
        lambda k: F.struct((F.col("b") * BLOCK + k).alias("at"), F.regexp_extract(F.lower(F.substring("text", k, F.lit(PIECE))), r"^\p{L}*", 0).alias("ahead")),
    )
    each = blocks.select("id", "size", F.explode(F.filter(ahead, lambda p: F.length(p["ahead"]) >= SHORTEST_WORD)).alias("p")).select("id", "size", "p.*")
    sizes = F.sequence(F.lit(SHORTEST_WORD), F.length("ahead"))
    pieces = each.select("id", "at", F.explode(F.transform(sizes, lambda n: F.left("ahead", n))).alias("piece"))
    short = pieces.join(words.where(F.length("word") <= PIECE), F.col("piece") == F.col("word")).select("id", "at")
    longer = words.where(F.length("word") > PIECE).withColumn("piece", F.left("word", F.lit(PIECE)))
    fits = (F.col("ahead") == F.col("piece")) & (F.col("at") + F.length("word") - 1 <= F.col("size"))
    maybe = each.where(F.length("ahead") == PIECE).join(longer, fits).select("id", "at", "word")
    full = maybe.join(values, "id").where(F.lower(F.expr("substring(value, at, length(word))")) == F.col("word")).select("id", "at")
    counted = short.unionByName(full).groupBy("id").agg(F.countDistinct("at").alias("covered"))
    return values.join(counted, "id").select("value", "covered")


def _share(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _named() -> Column:
    return F.col("left").rlike(CREDENTIAL) | F.col("value").rlike(NAMED_WITHIN)


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Findings with the numbers that the forest sees."""
    value, left, right = F.col("value"), F.col("left"), F.col("right")
    flag = lambda c: c.cast("double")
    out = found.join(covered(found, words), "value", "left")
    return out.withColumns(
        {
            "size": F.log2(F.length(value)),
            "digits": _share("[0-9]", value),
            "uppers": _share("[A-Z]", value),
            "symbols": _share("[+/_=-]", value),
            "class_changes": _share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", value),
            "case_changes": _share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])", value),
            "vowel_changes": _share("(?<=[aeiouAEIOU])(?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])", value),
            "coverage": F.coalesce(F.col("covered"), F.lit(0)) / F.length(value),
            "in_path": flag(left.rlike(r"(://|[./\\])\S*$") | right.rlike(r"^[./\\]\S")),
            "slashes": _share("/", value),
            "named": flag(_named()),
            "digested": flag(left.rlike(DIGEST)),
            "issued": flag(value.rlike(ISSUED)),
            "quoted": flag(left.rlike("[\"'`]$")),
            "assigned": flag(left.rlike("[:=]\\s*[\"'`]?$")),
            "wordy_left": _share(r"\p{L}", left),
            "wordy_right": _share(r"\p{L}", right),
        }
    )


def labels() -> Column:
    """1 and 0 for findings that are beyond doubt, null for all others."""
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    plain = F.col("value").rlike("^([A-Za-z=_/-]+|[0-9=/_-]+)$")
    named = _named()
    prose = F.col("left").rlike(r"\w\s+$") & F.col("value").rlike(r"^[A-Za-z]?[a-z]{0,14}[!?:]*$")
    return F.when(mixed & (named | F.col("value").rlike(ISSUED)), 1.0).when(prose | ~named & (plain | F.col("left").rlike(DIGEST)), 0.0)


def training(own: DataFrame, sample: int) -> DataFrame:
    """Of each label the ``sample`` distinct findings with the smallest hash, with the number of their copies."""
    key = ["value", "left", "right", "label"]
    known = own.where("label IS NOT NULL").withColumn("label", F.col("label").cast("double"))
    distinct = known.groupBy(*key).agg(F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in FEATURES))
    drawn = [distinct.where(F.col("label") == y).orderBy(F.xxhash64(*key), *key).limit(sample) for y in (0.0, 1.0)]
    return drawn[0].unionByName(drawn[1])


def bare(known: DataFrame) -> DataFrame:
    """The findings as if they stood in any text, without a name or mark beside them."""
    any_share = {c: F.pmod(F.xxhash64(F.lit(c), "value", "left", "right"), F.lit(1000)) / 1000 for c in SURROUNDINGS}
    return known.withColumns({c: F.lit(0.0) for c in EVIDENCE} | any_share)


def judged(docs: DataFrame, label: Column | None = None, sample: int = 20_000, share: float = 1e-4) -> DataFrame:
    """Every finding with its label, the forest's score and whether it is a secret.

    ``label`` is 1, 0 or null, over doc_id, start, end, value, left and right.
    """
    found = stored(findings(docs), "findings")
    own = featured(found, stored(dictionary(docs, share), "words")).withColumn("label", labels() if label is None else label)
    own = stored(own, "features")
    known = stored(training(own, sample), "training")
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    kinds = {r[0] for r in known.select("label").distinct().collect()}
    if kinds == {0.0, 1.0}:
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        scored = forest.fit(vector.transform(known.unionByName(bare(known)))).transform(vector.transform(own))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    else:
        scored = own.withColumn("score", F.lit(None).cast("double"))
    return scored.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", "label", "score",
        F.coalesce(F.col("score") >= 0.5, F.lit(True)).alias("is_secret"),
    )
