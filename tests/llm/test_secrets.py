import random
import re

import pytest
from pyspark.sql import functions as F

from spoorline.llm import secrets

SF = "/root/testdata/sf0.01"


def brute(text):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.CANDIDATE, text or "")]


def test_candidates_and_positions(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    expected = sorted(((d, *f) for d, t in docs.collect() for f in brute(t)), key=repr)
    assert rows(secrets.findings(docs), "doc_id", "start", "end", "value") == expected and expected


NAMES = re.compile(secrets.NAMES, re.I)


def names_at(text, k):
    """Every way in which a credential's name stands at a place, in the order of the list."""
    for one in secrets.NAMES.split("|"):
        if found := re.compile(one, re.I).match(text, k):
            yield found.end()


def next_name(text, k):
    return any(text[e : e + 1] and text[e] in "\"'`)]}:=>|" or text.startswith("->", e) for e in names_at(text, k))


def values_at(text, e):
    """(start, end) of a value behind the marks that may follow a name: all ways, the preferred first."""
    quotes = 0
    while quotes < 2 and text[e + quotes : e + quotes + 1] and text[e + quotes] in "\"'`)]}":
        quotes += 1
    for q in range(quotes, -1, -1):
        k = e + q
        while k < len(text) and text[k].isspace():
            k += 1
        ways = [k + 2] if text.startswith("->", k) else []
        signs = 0
        while signs < 3 and text[k + signs : k + signs + 1] and text[k + signs] in ":=>|":
            signs += 1
        ways += [k + n for n in range(signs, 0, -1)]
        spaced = []
        for w in ways:
            while w < len(text) and text[w].isspace():
                w += 1
            spaced.append(w)
        for w in [*spaced, k]:
            opened = w < len(text) and text[w] in "\"'`([{<"
            for v in [w + 1, w] if opened else [w]:
                before = text[v - 1]
                for quote in "\"'`":
                    end = text.find(quote, v)
                    if before == quote and end > v and "\n" not in text[v:end]:
                        yield e, v, end
                end = v
                while before == ">" and end < len(text) and text[end] not in "<\n" and not next_name(text, end):
                    end += 1
                if end > v and text.startswith("</", end):
                    yield e, v, end
                if v < len(text) and (before.isspace() or before in "\"'`)]}:=>|([{<") and not text[v].isspace() and text[v] not in "\"'`":
                    end = v + 1
                    while end < len(text) and not text[end].isspace() and not next_name(text, end):
                        end += 1
                    yield e, v, end


def longhand(text):
    """All candidates by looking at every place of a text."""
    runs = [(m.start(), m.end()) for m in re.finditer(secrets.CANDIDATE, text)]
    others, k = [], 0
    while k < len(text):
        done = None
        for e in names_at(text, k):
            if e < len(text) and (text[e].isspace() or text[e] in "\"'`)]}:=>|-"):
                if done := next(values_at(text, e), None):
                    break
        if not done:
            k += 1
            continue
        e, v, end = done
        opener = text[v - 1] if v > e else ""
        closed = opener in ("\"", "'", "`", ">") and (text[end : end + 1] == opener or opener == ">" and text.startswith("</", end))
        if not closed:
            while end > v and text[end - 1] in secrets.CLOSING:
                end -= 1
        others.append((v, end))
        k = e
    for m in re.finditer(r"://((?:[^\s/:@\"<>]*:)?+)([^\s/@\"<>][^\s/\"<>]*)@", text):
        others.append((m.start(2), m.end(2)))
    kept = {(v, end) for v, end in others if end > v and not any(a <= v and end <= b for a, b in runs)}
    return sorted((a, b, text[a:b]) for a, b in {*runs, *kept})


def test_candidates_equal_a_search_of_every_place(spark):
    rng, texts = random.Random(8), []
    parts = ["token", "Password", "pwd", "api_key", "auth", "secret", "=", ":", "->", " ", " ", "\n", "\"", "'", "`", "<b>", "</b>", ">", "x1!", "a.b", "hunter2", "zz", ")", "(", "}", "|", "://", "@", "/", "u:p", "abcdefgh12345678XY", "é"]
    for _ in range(3000):
        texts.append("".join(rng.choices(parts, k=rng.randint(1, 14))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in secrets.findings(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end, r.value))
    for k, text in enumerate(texts):
        assert sorted(found.get(k, [])) == longhand(text), text
    assert len(found) > 1000


@pytest.mark.parametrize("unit", ["token:x!;", "token)x!", "token>x!", "pwd=a", "://u:p@"])
def test_values_together_are_no_longer_than_the_text(spark, unit):
    text = unit * (1_000_000 // len(unit))
    found = secrets.findings(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    n, total = found.agg(F.count("*"), F.sum(F.length("value"))).first()
    assert n > 0 and total <= len(text)


def test_secrets_without_a_name_and_digests_with_one(spark):
    """What the labels do not tell: of either kind none has a label, or one with its reason hidden."""
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    docs, kinds = [], {}
    for k, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()):
        value, shown = draw(letters, 32), rng.choice(["api_key = \"%s\"", "token: %s", "secret = %s"])
        if k % 8 == 3:
            shown = "%s"
            kinds[value] = "nameless secret"
        elif k % 8 == 4:
            value, shown = draw("0123456789abcdef", rng.choice([40, 64])), rng.choice(["sha256: %s", "commit %s", "md5 = %s"])
            kinds[value] = "named digest"
        elif k % 8 == 5:
            value, shown = "-".join(rng.choices(["report", "annual", "final", "draft", "summary", "index"], k=4)), "see %s"
            kinds[value] = "slug"
        elif k % 8 > 5:
            value, shown = "", "%s"
        words = (r.text or "").split(" ")
        at = rng.randrange(len(words) + 1)
        docs.append((k, " ".join([*words[:at], shown % value, *words[at:]])))
    share = {}
    for r in secrets.judged(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        if r.value in kinds:
            share.setdefault(kinds[r.value], []).append(r.is_secret)
    assert len(share["nameless secret"]) > 100 and len(share["named digest"]) > 100
    assert sum(share["nameless secret"]) >= 0.95 * len(share["nameless secret"])
    assert sum(share["named digest"]) <= 0.02 * len(share["named digest"])
    assert sum(share["slug"]) <= 0.02 * len(share["slug"])


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('é password = "hunter2!x" and', "hunter2!x"),
        ("pwd: S3cr.t#9, then", "S3cr.t#9"),
        ("at postgres://u:pw@host/db now", "pw"),
        ("at postgres://u:p@w:1@host/db now", "p@w:1"),
        ("at https://tok3n@host now", "tok3n"),
        ('{"passwd": "a b c", "x": 1}', "a b c"),
        ("<password>h.u$2</password>", "h.u$2"),
        ("password token=x.y", "x.y"),
        ("PWD=$x!", "$x!"),
        ("PWD=" + "a.b" * 20_000, "a.b" * 20_000),
        ("password: abcdefghijklmnop!xyz9", "abcdefghijklmnop!xyz9"),
    ],
)
def test_values_by_context(spark, text, value):
    found = secrets.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert value in {r.value for r in found}
    for r in found:
        assert text[r.start : r.end] == r.value and text[: r.start].endswith(r.left) and text[r.end :].startswith(r.right)


def test_short_secrets_stay_and_prose_goes(spark):
    rows = [(k, f'the password = "h{k}.x!{k % 7}" is set, a token of thanks, the secret was kept') for k in range(100, 300)]
    found = secrets.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    verdict = {(r.value, r.is_secret) for r in found}
    assert ("h150.x!3", True) in verdict and ("of", False) in verdict and ("was", False) in verdict


def test_dictionary_keeps_every_frequent_word_of_any_length(spark):
    texts = [" ".join("w" + "".join(chr(97 + int(c)) for c in f"{k:05d}") for k in range(6_000)) + " Internationalisierungsstrategie"] * 2 + ["a1bcd2 rare"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None)], "doc_id long, text string")
    words = {r.word for r in secrets.dictionary(docs, 0.5).collect()}
    assert len(words) == 6_001 and "internationalisierungsstrategie" in words and "rare" not in words
    assert {r.word for r in secrets.dictionary(docs, 1e-4).collect()} == words | {"rare"}


def test_places_at_which_words_begin(spark):
    words = ["the", "then", "internationalisierung", "internationalisierungen", "national", "q" * 30]
    values = ["xTheN9the_internationalisierung", "internationalisierunx", "Q" * 40, "9" * 994 + "internationalisierung", "0123", "ab", "the"]
    found = spark.createDataFrame([(v,) for v in values * 2], "value string")
    own = {r.value: r.covered for r in secrets.covered(found, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    expected = {v: sum(any(v.lower().startswith(w, k) for w in words) for k in range(len(v))) for v in values}
    assert own == {v: n for v, n in expected.items() if n}


def test_forest_on_held_out_findings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    found = secrets.judged(docs, F.when(~held, secrets.labels())).where(held)
    truth = secrets.findings(docs).withColumn("truth", secrets.labels()).select("doc_id", "start", "truth")
    own = found.join(truth, ["doc_id", "start"]).where("truth IS NOT NULL").agg(F.count("*"), F.avg((F.col("is_secret") == (F.col("truth") == 1)).cast("int"))).first()
    assert own[0] > 5 and own[1] > 0.95


def test_false_positives_go_and_secrets_stay(spark):
    rows = [(k, f'the api_key = "{k:032x}" is set and plainwordsthatruntogether{"x" * (k % 5)} stay') for k in range(100, 400)]
    rows += [(1000, "TOKEN: 9f8e7d6c5b4a39281706f5e4d3c2b1a0"), (1001, "internationalisierungsstrategie"), (1002, "1234567890123456789")]
    found = secrets.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    verdict = {(r.doc_id, r.value): r.is_secret for r in found}
    assert verdict[(1000, "9f8e7d6c5b4a39281706f5e4d3c2b1a0")]
    assert not verdict[(1001, "internationalisierungsstrategie")] and not verdict[(1002, "1234567890123456789")]


def test_training_sample_has_both_labels_and_no_copies(spark):
    rows = [("copy", "l", "r", 0.0)] * 500 + [(f"v{k}", "l", "r", 0.0) for k in range(50)] + [("key", "l", "r", 1.0), ("odd", "l", "r", None)]
    own = spark.createDataFrame(rows, "value string, left string, right string, label double")
    own = own.withColumns({c: F.lit(0.5) for c in secrets.FEATURES})
    found = [(r.value, r.label, r.copies) for r in secrets.training(own, 1_000).collect()]
    assert len(found) == 52 and ("copy", 0.0, 500) in found and ("key", 1.0, 1) in found
    few = secrets.training(own, 10).collect()
    assert [r.label for r in few].count(0.0) == 10 and [r.label for r in few].count(1.0) == 1


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    key = "0123456789abcdef" * 2
    rows = [(1, None, "x", 1), (2, "", "y", 2), (None, f"é token={key}", "z", 3), (4, key, "q", 4), (4, key, "q", 4), (5, "a" * 50_000, "l", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string, score int")
    found = [(r.doc_id, r.start, r.end, r.score, r.is_secret) for r in secrets.judged(docs, F.lit(None).cast("double")).collect()]
    assert sorted(found, key=repr) == sorted([(None, 2, 40, None, True), (4, 0, 32, None, True), (4, 0, 32, None, True), (5, 0, 50_000, None, True)], key=repr)
    assert secrets.judged(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, plan):
    from spoorline.llm.queries import QUERIES

    assert not re.search("Python|Pandas|Arrow", plan(QUERIES["op3_secrets"](spark, "/root/testdata/sf0.001")))
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES["op8_shards"](spark, "/root/testdata/sf0.001")))
