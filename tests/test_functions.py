"""Vectors of the scalar functions, signatures, subjects and templates."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from eventflow.functions import documents as doc
from eventflow.functions import signatures as sig
from eventflow.functions import text as txt
from eventflow.functions.subjects import (
    inventory_match,
    literal_prefix,
    resolve_subject,
    scan_pattern,
    subject_match,
)
from eventflow.functions.templates import render
from eventflow.operators import events as ev
from eventflow.operators import fleet, responder
from eventflow.sources.ticks import ticks_per_trigger

L = F.lit


def values(spark, rows, make):
    """Evaluate ``make(col)`` over a list of inputs, in order."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v string")
    return [r[1] for r in df.select("i", make(F.col("v"))).orderBy("i").collect()]


MATCHES = [
    ("a.b", "a.b", True),
    ("a.b", "a.c", False),
    ("test.*.one", "test.x.one", True),
    ("test.*.one", "test.x.y.one", False),
    ("test.wildcard.*", "test.wildcard.one", True),
    ("test.wildcard.*", "test.wildcard", False),
    ("test.>", "test", False),
    ("test.>", "test.a", True),
    ("test.>", "test.a.b.c", True),
    (">", "anything.at.all", True),
    ("*.failed", "payment.failed", True),
    ("a.*.>", "a.b", False),
    ("a.*.>", "a.b.c.d", True),
    ("a+b.c", "a+b.c", True),
    ("a+b.*", "aab.c", False),
]


def test_subject_match(spark):
    for pattern in {p for p, _, _ in MATCHES}:
        cases = [(s, want) for p, s, want in MATCHES if p == pattern]
        got = values(spark, [s for s, _ in cases], lambda c: subject_match(c, pattern))
        assert got == [w for _, w in cases], pattern


def test_pattern_helpers():
    assert literal_prefix("river.stripe.>") == "river.stripe."
    assert literal_prefix("river.x") == "river.x"
    assert literal_prefix(">") == ""
    assert scan_pattern("", "river.") == "river.>"
    assert scan_pattern("general.>", "river.") == "river.general.>"
    assert scan_pattern("river.a", "river.") == "river.a"


def test_inventory_match(spark):
    subjects = ["a.b.c", "a.>", "a", "a.b", "a.*.>"]
    assert values(spark, subjects, lambda c: inventory_match(c, "a.>")) == [True, True, False, True, True]
    assert values(spark, subjects, lambda c: inventory_match(c, "a.*")) == [False, True, False, True, False]
    # A pattern mixing both wildcards is only ever its own text (or a literal prefix).
    assert values(spark, subjects, lambda c: inventory_match(c, "a.*.>")) == [False, False, False, False, True]


@pytest.mark.parametrize(
    ("template", "data", "want"),
    [
        ("orders.{region}.{step}", '{"step":"packed","region":"north","weight":7}', "orders.north.packed"),
        ("{kind}", '{"kind":"audit"}', "audit"),
        ("{a}{b}", '{"a":"left","b":"right"}', "leftright"),
        ("ends.in.{n}", '{"n":-3}', "ends.in.-3"),
        ("no.fields", '{"no":"fields"}', "no.fields"),
        ("twice.{k}.{k}", '{"k":"x"}', "twice.x.x"),
        ("dots.{k}", '{"k":"p.q"}', "dots.p.q"),
        ("{gone}.kept", '{"kept":1}', "{gone}.kept"),
        ("a.{x}", '{"x":null}', "a.<nil>"),
        ("a.{x}", '{"x":true}', "a.true"),
        ("a.{x}", '{"x":1234567890123}', "a.1234567890123"),
    ],
)
def test_dynamic_subject(one, template, data, want):
    assert one(resolve_subject(template, doc.decode(L(data)))) == want


@pytest.mark.parametrize(
    ("data", "path", "want"),
    [
        ('{"next": "page-2", "prev": "page-0"}', "next", "page-2"),
        ('{"paging": {"links": {"after": "k9"}}}', "paging.links.after", "k9"),
        ('{"paging": {"after": "k9"}}', "$.paging.after", "k9"),
        ('{"offset": -17}', "offset", "-17"),
        ('{"paging": {"after": "k9"}}', "paging.before", ""),
        ('{"paging": "k9"}', "paging.after", ""),
        ('{"x": ""}', "x", ""),
        ('{"x": 1}', "", ""),
        ('{"a": true}', "a", "true"),
        ('{"a": 1.5}', "a", "1.5"),
        ('{"a": null}', "a", ""),
        ('{"a": {"b": 1}}', "a", ""),
        ('{"a": [1, 2]}', "a", ""),
        ('{"a": [1, 2]}', "a.0", ""),
        ('{"a": "[x"}', "a", "[x"),
        ("{broken", "a", ""),
        ("[1]", "0", ""),
    ],
)
def test_json_path(one, data, path, want):
    assert one(doc.path_text(L(data), path)) == want


def test_json_guard(spark):
    docs = ['{"a":1}', "  \n{}", "[1]", "null", '"x"', "{broken", "", None]
    assert values(spark, docs, doc.is_object) == [True, True, False, False, False, False, False, False]


def test_string_field(spark):
    docs = ['{"type":"x"}', '{"type":1}', '{"type":null}', "{}", "[1]", "{broken", '{"type":""}']
    got = values(spark, docs, lambda c: doc.string_field(doc.decode(c), "type"))
    assert got == ["x", None, None, None, None, None, ""]


def test_merge_fields(one):
    text = one(doc.merge_fields(L('{"a":1,"_subject":"old","n":null,"t":[1]}'), {"_subject": L("s")}))
    import json

    assert json.loads(text) == {"a": 1, "_subject": "s", "n": None, "t": [1]}


def test_encode_keeps_empty_arrays_and_nulls(one):
    assert one(doc.encode(F.struct(F.array().cast("array<string>").alias("a"), L(None).cast("int").alias("n")))) == '{"a":[],"n":null}'


@pytest.mark.parametrize(
    ("size", "want"),
    [
        (1, "1B"),
        (1023, "1023B"),
        # Ties go to the even unit: 2.5 and 3.5 KB, 6.5 and 7.5 MB.
        (2 * 1024 + 512, "2KB"),
        (3 * 1024 + 512, "4KB"),
        (13 * 1024**2 // 2, "6MB"),
        (15 * 1024**2 // 2, "8MB"),
        # The largest size below a unit is rounded up without changing to it.
        (1024**2 - 1, "1024KB"),
        (1024**4 - 1, "1024GB"),
        (7 * 1024**3, "7GB"),
        # Terabytes have one decimal and are the last unit.
        (5 * 1024**4 // 4, "1.2TB"),
        (2048 * 1024**4, "2048.0TB"),
    ],
)
def test_format_bytes(one, size, want):
    assert one(txt.format_bytes(L(size).cast("bigint"))) == want


def test_format_bytes_spaced(one):
    sizes = [1023, 1536, 5 * 1024**2, 1024**4, 3 * 1024**5, 2 * 1024**6]
    got = [one(txt.format_bytes_spaced(L(s).cast("bigint"))) for s in sizes]
    assert got == ["1023 B", "1.5 KB", "5.0 MB", "1.0 TB", "3.0 PB", "2.0 EB"]


def test_format_duration(one):
    got = [one(txt.format_duration(L(float(s)))) for s in (0.9, 59.9, 60, 3599, 3600, 86399, 86400, 200000)]
    assert got == ["0s", "59s", "1m", "59m", "1h", "23h", "1d", "2d"]


@pytest.mark.parametrize(
    ("spelled", "seconds"),
    [
        ("30s", 30.0),
        ("5m", 300.0),
        ("1h30m", 5400.0),
        ("1.5h", 5400.0),
        ("-2m", -120.0),
        ("250ms", 0.25),
        ("0", 0.0),
        ("5", None),
        ("abc", None),
        ("", None),
        ("1h x", None),
    ],
)
def test_intervals(one, spelled, seconds):
    assert one(txt.parse_interval(L(spelled))) == seconds
    if seconds is None:
        with pytest.raises(ValueError):
            txt.interval_seconds(spelled)
    else:
        assert txt.interval_seconds(spelled) == seconds


@pytest.mark.parametrize(
    ("interval", "hz", "want"),
    [
        ("7s", 11, 77),
        ("1h2m3s", 2, 7446),
        ("2.9s", 50, 100),  # whole seconds count
        ("999ms", 60, 1),  # never less than one
        ("45s", -3, 4050),  # a rate that is no rate takes the default
        ("-5s", 10, 600),  # as does an interval that does not last
        ("0", 7, 420),
    ],
)
def test_ticks_per_trigger(interval, hz, want):
    assert ticks_per_trigger(interval, hz) == want


def test_interval_text(one):
    assert [one(txt.interval_text(L(s))) for s in (5, 65, 3605, 7200)] == ["5s", "1m5s", "1h0m5s", "2h0m0s"]


# --- signatures ---------------------------------------------------------------------------

BODY = '{"event":"test","ü":1}'


@pytest.mark.parametrize("secret", ["s3cret", "k" * 200])
@pytest.mark.parametrize("bits", [256, 512])
def test_hmac_equals_the_standard_library(one, secret, bits):
    want = hmac.new(secret.encode(), BODY.encode(), f"sha{bits}").hexdigest()
    assert one(sig.hmac_hex(secret, L(BODY), bits)) == want


def digest(text, secret="s3cret", algo=hashlib.sha256):
    return hmac.new(secret.encode(), text.encode(), algo).hexdigest()


def test_plain_verdicts(one):
    good = digest(BODY)
    cases = {good: "ok", "sha256=" + good: "ok", "wrong": "mismatch", "": "missing"}
    for given, want in cases.items():
        assert one(sig.verify_plain("s3cret", L(BODY), L(given))) == want
    assert one(sig.verify_plain("s3cret", L(BODY), L(None).cast("string"))) == "missing"
    assert one(sig.verify_plain("s3cret", L(BODY), L("sha512=" + digest(BODY, algo=hashlib.sha512)), 512)) == "ok"


def test_prefixed_verdicts(one):
    good = digest(BODY)
    for prefix in ("sha256=", "v0="):
        cases = {prefix + good: "ok", good: "no_prefix", prefix + "ab": "mismatch", "": "missing"}
        for given, want in cases.items():
            assert one(sig.verify_prefixed("s3cret", L(BODY), L(given), prefix)) == want


def test_timestamped_verdicts(one):
    now = F.timestamp_seconds(L(1_700_000_000))

    def verdict(header, **kw):
        return one(sig.verify_timestamped("s3cret", L(BODY), L(header), now, **kw))

    def header(t):
        return f"t={t},v1={digest(f'{t}.{BODY}')}"

    assert verdict(header(1_700_000_000)) == "ok"
    assert verdict(header(1_700_000_000 - 300)) == "ok"
    assert verdict(header(1_700_000_000 - 301)) == "too_old"
    assert verdict(header(1_700_000_000 - 301), tolerance=600) == "ok"
    assert verdict(header(1_700_009_999)) == "ok"
    assert verdict("v1=x") == "bad_format"
    assert verdict("t=1,v1=") == "bad_format"
    assert verdict("t=abc,v1=x") == "bad_timestamp"
    assert verdict("t=1700000000,v1=x") == "mismatch"
    assert verdict("") == "missing"
    assert verdict("v1=old," + header(1_700_000_000)) == "ok"


def test_header_and_scheme(one):
    headers = F.create_map(L("X-Signature-256"), L(""), L("Stripe-Signature"), L("t=1"), L("X-Slack-Signature"), L("v0=1"))
    assert one(sig.pick_header(headers)) == "t=1"
    assert one(sig.pick_header(F.create_map(L("Other"), L("x")))) == ""
    assert one(sig.pick_scheme(L("/webhooks/stripe"))) == "timestamped"
    assert one(sig.pick_scheme(L("/x"), False)) == "none"
    assert one(sig.verify_request(L("/x"), None, L("b"), headers, F.current_timestamp())) == "ok"


# --- templates and answers ----------------------------------------------------------------


@pytest.mark.parametrize(
    ("template", "data", "want"),
    [
        ("Score {{.score}}", '{"score":85}', "Score 85"),
        ("{{.signals}}", '{"signals":["a","b"]}', "[a b]"),
        ("{{.a.b}}-{{.c}}", '{"a":{"b":"x"}}', "x-<no value>"),
        ("{{if .r}}re {{.r}}{{end}}!", '{"r":"7"}', "re 7!"),
        ("{{if .r}}re {{.r}}{{end}}!", '{"r":""}', "!"),
        ("{{if .n}}y{{else}}n{{end}}", '{"n":0}', "n"),
        ("{{if .n}}y{{else}}n{{end}}", '{"n":0.5}', "y"),
        ("{{if .n}}y{{else}}n{{end}}", '{"n":[]}', "n"),
        ("{{if .n}}y{{else}}n{{end}}", "{}", "n"),
        ("{{range .items}}<{{.}}>{{end}}", '{"items":[1,"x",true]}', "<1><x><true>"),
        ("{{range .items}}{{.id}}{{if .last}}.{{else}},{{end}}{{end}}", '{"items":[{"id":1},{"id":2,"last":true}]}', "1,2."),
        ("{{range .items}}x{{end}}", "{}", ""),
        ("plain", "{}", "plain"),
    ],
)
def test_render(one, template, data, want):
    assert one(render(template, doc.decode(L(data)))) == want


def test_render_rejects_unknown_tags(one):
    with pytest.raises(ValueError):
        one(render("{{template x}}", doc.decode(L("{}"))))
    with pytest.raises(ValueError):
        one(render("a{{end}}", doc.decode(L("{}"))))


def test_parse_answer(one):
    assert one(responder.parse_answer(L('{"a":1}'))) == '{"a":1}'
    assert one(responder.parse_answer(L("hi"))) == '{"response":"hi"}'
    assert one(responder.parse_answer(L("[1]"))) == '{"response":"[1]"}'


def test_entity_id(spark):
    docs = ['{"id":"a","contact_id":"b"}', '{"id":1,"contact_id":"b"}', '{"id":"","contact_id":"b"}', '{"entity_id":"e"}', "{}"]
    assert values(spark, docs, lambda c: responder.entity_id(doc.decode(c))) == ["a", "b", None, "e", None]


def test_rules(one):
    answer = one(responder.ask_rules(L('{"platform": "telegram", "chat_id":  "42"}')))
    assert '"chat_id": "42"' in answer
    assert "pursue" in one(responder.ask_rules(L('{"platform": "", "chat_id": "42"}')))


# --- classification -----------------------------------------------------------------------

KINDS = [
    ("river.stripe.webhook", "tree"),
    ("river.general.api", "tree"),
    ("payment.completed", "nim"),
    ("payment.failed", "nim"),
    ("contact.created", "treehouse"),
    ("lead.scored", "treehouse"),
    ("data.received", "nim"),
    ("unknown.subject", "nim"),
    ("my.treehouse.x", "treehouse"),
]


def test_process_kind(spark):
    subjects = [s for s, _ in KINDS]
    assert values(spark, subjects, fleet.kind_by_prefix) == [k for _, k in KINDS]
    assert values(spark, subjects, fleet.process_kind) == [k for _, k in KINDS]


def test_process_name(spark):
    subjects = ["river.stripe.webhook", "river.general.>", "payment.*", "river.>", "", "a.b.c", "river."]
    want = ["stripe-webhook", "general", "payment", ">", "unknown", "a-b-c", "unknown"]
    assert values(spark, subjects, fleet.process_name) == want


def test_visible(spark):
    assert values(spark, ["", "_INBOX.x", "$SYS.y", "a._b"], fleet.visible) == [False, False, False, True]


def test_json_too_large_has_a_reason_of_its_own(spark):
    big = F.concat(F.lit('{"a":["'), F.repeat(F.concat(F.repeat(F.lit("x"), 1000), F.lit('","')), 140_000), F.lit('"]}'))
    rows = spark.range(1).select(F.explode(F.array(big, F.lit('{"a":1}'), F.lit("{broken}"), F.lit("[1]"), F.repeat(F.lit("{"), 3_000_000))).alias("data"))
    got = ev.guard_payload(rows).select(F.length("data").alias("n"), "reject_reason").collect()
    assert {r.n: r.reject_reason for r in got} == {140_420_010: "too large", 7: None, 8: "not json", 3: "not an object", 3_000_000: "not json"}
