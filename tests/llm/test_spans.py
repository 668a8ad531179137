"""op1 and op6: base spans against the patterns as stated, added spans on disguises, odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import pii, secrets

from .conftest import odd_rows, rows_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def plain_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", *m.span()) for m in EMAIL.finditer(t)]
    found += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(found + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15])


def plain_secrets(t):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(t) if len(m.group()) >= 16]
    return sorted(found + [("hex", *m.span()) for m in HEX.finditer(t) if len(m.group()) >= 32])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ 5()2é", max_size=40))
def test_base_pii_is_the_patterns(t):
    assert sorted(map(tuple, pii.detect(t))) == plain_pii(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "ſecret", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "A1B2C3D4E5F6", "abcdef12", "0123456789abcdef", "x", "\n"]), max_size=14).map("".join))
def test_base_secrets_are_the_patterns(t):
    assert sorted(secrets.base_spans(t)) == plain_secrets(t)


DISGUISED = {
    "john [at] example [dot] com!": ("email", "john [at] example [dot] com"), "mail jane.doe at mail dot example dot org now": ("email", "jane.doe at mail dot example dot org"),
    "joһn@exаmple.com": ("email", "joһn@exаmple.com"), "x_at_example_dot_com": ("email", "x_at_example_dot_com"), "plus one four one five five five five zero one three four": ("phone", "plus one four one five five five five zero one three four"),
    "ip one nine two dot one six eight dot one dot five end": ("ip", "one nine two dot one six eight dot one dot five"), "４１１１ １１１１ １１１１ １１１１": ("card", "４１１１ １１１１ １１１１ １１１１"), "4lll 1111 1111 1111": ("card", "4lll 1111 1111 1111"),
    "x&#64;y&#46;com": ("email", "x&#64;y&#46;com"), "jo%40ex.org": ("email", "jo%40ex.org"), "jane @ example.com": ("email", "jane @ example.com"), "tel +1 (zero one seven) five five five-7713": ("phone", "+1 (zero one seven) five five five-7713"),
    "four " + "one " * 15 + "end": ("card", "four" + " one" * 15), "a​b@exam​ple.com": ("email", "a​b@exam​ple.com"),
}


def test_disguises_map_back_to_source_characters():
    for t, (kind, piece) in DISGUISED.items():
        assert (kind, piece) in [(s.kind, t[s.start : s.end]) for s in pii.find(t)[1]], t


def test_clean_prose_gains_nothing():
    for t in ("We met at noon; the dot was red.", "one of the two, three times at seven", "She is at home. See example.com or call nine", "Straße, élève, niño: 3.5 to 1"):
        assert pii.find(t) == ([], [])


def test_transducers_compose_their_maps():
    m = pii.Mapped("ab[at]cd")
    m.rewrite([(2, 6, "@")])
    m.rewrite([(0, 1, ""), (3, 4, "XY")])
    assert (m.text, m.start, m.end) == ("b@XYd", [1, 2, 6, 6, 7], [2, 6, 7, 7, 8])


def test_random_strings_are_found_and_names_are_not():
    rng = random.Random(1)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(100)]
    assert all(secrets.random_strings(f"say {k}.") == [(4, 36)] for k in keys)
    for t in ("my_function_name_with_version_12", "getElementsByClassName2AndMore", "d41d8cd98f00b204e9800998ecf8427e", "550e8400-e29b-41d4-a716-446655440000", "usr/share/lib/python3/dist-packages/numpy", "12345678901234567890123", "internationalisation" * 2):
        assert secrets.random_strings(t) == [], t


def test_odd_tables(odd, odd_wide, none):
    for scan, find in ((pii.detect_pii, pii.find), (secrets.scan_secrets, secrets.find)):
        joined = (pii if find is pii.find else secrets).joined
        expected = sorted(((i, joined(sum(find(t), []))) for i, t, *_ in odd_rows()), key=repr)
        assert rows_of(scan(odd).select("doc_id", "spans")) == expected == rows_of(scan(odd_wide).select("doc_id", "spans"))
        assert scan(none).count() == 0


def test_long_runs_take_linear_time():
    for t in ("a dot " * 80_000, "a at " * 80_000, "x at a dot " * 40_000, "a@" * 100_000, "1 dot " * 80_000, "1" * 300_000, "a." * 150_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 100_000):
        pii.find(t)


def test_query_columns_are_the_patterns(odd):
    """Counts and digests of op1 and op6, by the patterns as stated."""
    rng = random.Random(11)
    words = ["a.b@c.de", "x@y", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "token=abcdefgh12", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "plain", "é", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, ""]
    docs = odd.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for scan, plain, kinds in ((pii.detect_pii, plain_pii, pii.KINDS), (secrets.scan_secrets, plain_secrets, secrets.KINDS[:3])):
        for r in scan(docs).collect():
            base = sorted(plain(texts[r.doc_id] or ""), key=lambda x: (x[1], kinds.index(x[0])))
            assert [r[f"n_{k}"] for k in kinds] == [sum(b[0] == k for b in base) for k in kinds]
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
            assert r.n_all == len([x for x in r.spans.split(",") if x]) >= len(base)


_FIGURES = "zero one two three four five six seven eight nine".split()
_HOMOGLYPHS = str.maketrans("aeopcx", "аеорсх")
_WIDE = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(48, 58)})


def _spelled(t):
    return " ".join(_FIGURES[int(c)] if c.isdigit() else {".": "dot", "+": "plus"}.get(c, c) for c in t)


def planted(rng):
    """(kind, disguise, text) of made-up identifiers, each disguised in every way that its kind allows."""
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    user, host, top = letters(5) + rng.choice(["", ".", "_"]) + letters(4), letters(6), rng.choice(["com", "org", "net"])
    for name, at, dot in (("brackets", " [at] ", " [dot] "), ("round", "(at)", "(dot)"), ("words", " at ", " dot "), ("signs", "[@]", "[.]"), ("references", "&#64;", "&#46;"), ("spaced", " @ ", ".")):
        yield "email", name, f"{user}{at}{host}{dot}{top}"
    yield "email", "homoglyphs", f"{user}a@{host}o.{top}".translate(_HOMOGLYPHS)
    yield "email", "invisible", f"{user}@{host[:3]}\u200b{host[3:]}.{top}"
    ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
    yield "ip", "brackets", ip.replace(".", "[.]")
    yield "ip", "words", ip.replace(".", " dot ")
    yield "ip", "spelled", _spelled(ip)
    yield "ip", "wide", ip.translate(_WIDE)
    card = "".join(rng.choice("123456789") for _ in range(15))
    card += next(d for d in string.digits if pii.luhn(card + d))
    yield "card", "spelled", _spelled(card)
    yield "card", "wide", card.translate(_WIDE)
    yield "card", "letters", card.replace("1", "l", 3)
    phone = "+1" + "".join(rng.choice("23456789") for _ in range(10))
    yield "phone", "spelled", _spelled(phone)
    yield "phone", "wide", "+" + phone[1:].translate(_WIDE)
    yield "phone", "invisible", phone[:5] + "\u200b" + phone[5:]


def test_recall_of_planted_disguises():
    """Of each kind and disguise at least 9 in 10 are found at their place."""
    rng, tried, hit = random.Random(12), {}, {}
    for _ in range(200):
        for kind, name, t in planted(rng):
            source = f"call it, {t}, she said"
            spans = [(s.kind, source[s.start : s.end]) for s in sum(pii.find(source), [])]
            tried[kind, name] = tried.get((kind, name), 0) + 1
            hit[kind, name] = hit.get((kind, name), 0) + ((kind, t) in spans)
    recall = {k: hit[k] / n for k, n in tried.items()}
    print({f"{k}/{n}": r for (k, n), r in recall.items()})
    assert min(recall.values()) >= 0.9, recall


def test_recall_of_random_strings():
    """Random strings of any one case, of figures, and of capital hex, in a text; names and long words aren't found."""
    rng = random.Random(13)
    for signs, lengths, least in ((string.ascii_lowercase, (24, 32, 40), 0.9), (string.ascii_uppercase, (24, 32, 40), 0.95), (string.digits, (20, 24, 28), 0.9), ("0123456789ABCDEF", (24, 32, 40), 0.9), (string.ascii_letters + string.digits, (16, 18), 0.9), (string.ascii_letters + string.digits, (24, 40), 0.97)):
        for n in lengths:
            keys = ["".join(rng.choices(signs, k=n)) for _ in range(300)]
            assert sum(bool(secrets.random_strings(f"say {k} now")) for k in keys) >= least * len(keys), (signs, n)
    for t in ("electroencephalograph", "counterrevolutionaries", "bundesverfassungsgericht", "THISISAVERYLONGIDENTIFIER", "mysqlconnectionpoolmanager", "sha256: " + "0123456789ABCDEF" * 4):
        assert secrets.random_strings(t) == [], t
