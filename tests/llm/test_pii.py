import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorline.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    """The base as it is defined, by the plain patterns."""
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def base(text):
    return [(k, s, e) for k, s, e, plain in pii.find(text) if plain]


@given(st.text(alphabet="a1.@-+ ()29%_é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_is_as_defined(text):
    assert base(text) == brute(text)


def test_base_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    for (text,) in docs:
        assert base(text) == brute(text)
        assert len(pii.find(text)) == len(base(text))  # nothing is added to clean prose


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jane [at] example [dot] com today", "email", "jane [at] example [dot] com"),
        ("write to jane at example dot com today", "email", "jane at example dot com"),
        ("write to jane.doe(at)mail.example(dot)org.", "email", "jane.doe(at)mail.example(dot)org"),
        ("jane dot doe at example dot com", "email", "jane dot doe at example dot com"),
        ("see jane @ example.com now", "email", "jane @ example.com"),
        ("see jane @ example . com now", "email", "jane @ example . com"),
        ("jane[at]example.com", "email", "jane[at]example.com"),
        ("mail jаne@exаmple.com ok", "email", "jаne@exаmple.com"),
        ("mail jane＠example．com ok", "email", "jane＠example．com"),
        ("card four one one one 1111 1111 one one one one end", "card", "four one one one 1111 1111 one one one one"),
        ("card ４１１１ １１１１ １１１１ １１１１ end", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus four nine one five one two three four five six seven now", "phone", "plus four nine one five one two three four five six seven"),
        ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
        ("host 192\u200b.168.1\u200b.7 up", "ip", "192\u200b.168.1\u200b.7"),
        ("card 4lll 1111 1111 l111 end", "card", "4lll 1111 1111 l111"),
        ("host l92.168.O.1 up", "ip", "l92.168.O.1"),
        ("call +1 (zero one seven) five five five-7713 now", "phone", "+1 (zero one seven) five five five-7713"),
    ],
)
def test_disguises_map_back(text, kind, source):
    found = {(k, text[s:e]) for k, s, e, plain in pii.find(text) if not plain}
    assert (kind, source) in found


@pytest.mark.parametrize(
    ("kind", "source", "fragment"),
    [
        ("email", "jоhn@example.com", "hn@example.com"),
        ("email", "john@mail.exаmple.com", "john@mail.ex"),
        ("email", "jоhn@mail.exаmple.com", "hn@mail.ex"),
        ("phone", "+49 151 234 56 seven eight", "+49 151 234 56"),
        ("ip", "192.168.1.1\u200b7", "192.168.1.1"),
    ],
)
def test_a_plain_fragment_does_not_hide_the_whole(kind, source, fragment):
    text = f"see {source}, please"
    found = [(k, text[s:e], plain) for k, s, e, plain in pii.find(text)]
    assert (kind, source, False) in found and (kind, fragment, True) in found
    assert pii.redacted(text) == f"see [{kind.upper()}], please"


def test_what_a_plain_span_contains_is_not_added():
    text = "é mail john@example.com\u200b or call +49 151 234 56 78 now"
    assert [(text[s:e], plain) for _, s, e, plain in pii.find(text)] == [("john@example.com", True), ("+49 151 234 56 78", True)]


@pytest.mark.parametrize(
    "text",
    ["meet at example.com", "one of the two at three dot", "at dot at dot", "a at b. dot c", "I am at home. Dot came", "two three", "© 2020 – all at once"],
)
def test_prose_gives_nothing(text):
    assert pii.find(text) == []


def test_long_runs_are_linear():
    start = time.perf_counter()
    for text in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "one " * 60_000, "a at " * 60_000, "+1" * 100_000, "a dot " * 50_000, "é" * 200_000, "a@" * 100_000, " at" * 100_000, "(" * 200_000, " " * 200_000]:
        pii.find(text)
    assert time.perf_counter() - start < 40


def test_columns_nulls_and_redaction(spark):
    rows = [(1, None, "x"), (None, "a@b.c", "y"), (2, "", "z"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = docs.withColumn("found", pii.spans("text")).withColumn("clean", pii.redact("text"))
    found = sorted((r.spans, [s.kind for s in r.found], r.clean or "-") for r in out.collect())
    assert found == [("x", [], "-"), ("y", ["email"], "[EMAIL]"), ("z", [], "-"), ("z", [], "-")]
    assert docs.limit(0).select(pii.spans("text")).count() == 0


def test_query_digests(spark):
    from spoorline.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op5_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(texts[row.doc_id]))
        assert row.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert row.spans == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in pii.find(texts[row.doc_id]))
