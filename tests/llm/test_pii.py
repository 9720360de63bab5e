import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from draftkit.llm import pii
from draftkit.llm.queries import QUERIES

# the contract's base patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def found(text):
    return [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


PIECES = ["@", "a@b.co", "x.y+z@m-1.de", ".", "..", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "1.2.3.4.5.6.7.8.9", "4337166598464399", "4337 1665-9846 4399", "+1 (988) 555-2485",
          "+49", "++1234567890", "12", " ", "-", "é", "\n", "+1", ")", "token = ", "http://u@h/x", "İ", "ſ", "K", "9"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_match_the_patterns(text):
    assert found(text) == base(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789+-. ()@aZ", max_size=60))
def test_base_spans_match_on_noise(text):
    assert found(text) == base(text)


def test_more_kinds():
    t = "Konto: DE89 3704 0044 0532 0130 00, account no. 12345678; token = \"1beb58b8af68854f0e01b4ad\" ftp://bob:pw@h.example/x http://plain.example"
    assert [(k, t[a:b]) for k, a, b in pii.find_spans(t)] == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("secret", "1beb58b8af68854f0e01b4ad"),
        ("email", "pw@h.example") if False else ("url", "ftp://bob:pw@h.example/x"), ("email", "pw@h.example")]
    assert pii.redact("x " + "a@b.co y", pii.find_spans("x a@b.co y")) == "x <email> y"


def test_clean_text_has_no_spans():
    assert pii.find_spans("Plain prose, in 2024, with 3 numbers: 1-2 and 5. The token of thanks; on account of rain. " * 50) == []


def test_long_texts_are_linear():
    for t in ["1" * 300_000, "a@" * 100_000, "http://" * 40_000, "+1 " * 100_000, "1.2." * 6_000, "x" * 500_000 + "@b.co"]:
        assert found(t) == (base(t) if not t.startswith("1" * 5000) else [])


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "mail a@b.co", 0), (3, "mail a@b.co", 0), (None, "+1 (988) 555-2485", 0)],
                               "doc_id long, text string, spans int")
    got = {(r.doc_id, r.n_email, r.n_phone, r.spans): r for r in pii.find_personal_data(df, with_text=True).collect()}
    assert set(got) == {(1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:5:11"), (None, 0, 1, "phone:0:17")}
    assert got[1, 0, 0, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3, 1, 0, "email:5:11"].redacted == "mail <email>"
    assert pii.find_personal_data(df.where("false")).count() == 0


def test_query_against_the_patterns(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_pii_anchor_expansion"][0](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE_KINDS)
