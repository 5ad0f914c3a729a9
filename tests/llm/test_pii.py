import datetime
import hashlib
import random
import re

import pytest

from ledgerloom.llm import pii

KEY = "k1"


def h(value, tag):
    return int(hashlib.sha256(f"{tag}:{value}".encode()).hexdigest()[:15], 16)


def feistel(x, y, a, b, tag):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            x = (x + h(y, f"{tag}|{i}")) % a
        else:
            y = (y + h(x, f"{tag}|{i}")) % b
    return x, y


def digits(d, tag):
    left = len(d) // 2
    right = len(d) - left
    x, y = feistel(int(d[:left]), int(d[left:]), 10**left, 10**right, f"{tag}|{len(d)}")
    return f"{x:0{left}d}{y:0{right}d}"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))


def refill(form, new):
    it = iter(new)
    return re.sub(r"[0-9]", lambda _: next(it), form)


def brute_number(m):
    d, full = re.sub(r"\D", "", m), lambda p: re.fullmatch(p, m, re.A)
    if full(pii.DATE):
        for form in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y"):
            try:
                day = datetime.datetime.strptime(m, form).date()
            except ValueError:
                continue
            if not 1800 <= day.year <= 2199:
                return None, m
            n = (day - datetime.date(1800, 1, 1)).days
            x, y = feistel(n // 5411, n % 5411, 27, 5411, f"{KEY}|date")
            return "date", (datetime.date(1800, 1, 1) + datetime.timedelta(x * 5411 + y)).strftime(form)
        return None, m
    if full(pii.SSN):
        a, g, s = map(int, m.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and s):
            return None, m
        x, y = feistel(a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999, f"{KEY}|ssn")
        return "ssn", f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    if full(pii.IP):
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return None, m
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, f"{KEY}|ip")
        return "ip", f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if full(pii.CARD) and 13 <= len(d) <= 19 and luhn(d) % 10 == 0:
        body = digits(d[:-1], f"{KEY}|card")
        return "card", refill(m, body + str(-luhn(body + "0") % 10))
    if full(pii.PHONE) and 8 <= len(d) <= 15:
        return "phone", refill(m, d[0] + digits(d[1:], f"{KEY}|phone|{d[0]}"))
    return None, m


def brute(text):
    n = dict.fromkeys(pii.KINDS, 0)
    if text is None:
        return (None, *n.values())

    def mail(m):
        n["email"] += 1
        x = hashlib.sha256(f"{KEY}|email|{m[0].lower()}".encode()).hexdigest()
        return f"u{x[:12]}@d{x[12:20]}.example"

    def number(m):
        kind, new = brute_number(m[0])
        if kind:
            n[kind] += 1
        return new

    text = re.sub(pii.NUMBER, number, re.sub(pii.EMAIL, mail, text, flags=re.A), flags=re.A)
    return (text, *n.values())


TEXTS = [
    None, "", "no data here", "4111 1111 1111 1111 and 4111-1111-1111-1112, 9807915762804490", "a.b@c.example.com.", "A.B@C.example.com a.b@c.example.com", "@ @@ x@y a@b.c",
    "+1 (017) 555-7713 +44 20 7946 0958 555-123-4567 (212) 555-0000", "97.51.17.173 256.1.1.1 1.2.3.4.5 10.0.0.1.", "123-45-6789 666-12-3456 000-12-3456 899-99-9999", "2024-02-29 2023-02-29 31/12/1999 01.02.2003 1799-01-01 2200-01-01 1800-01-01 2199-12-31",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" 12345678901234567890", "x" * 60000 + "@" + "y" * 60000, "1" * 50000, "٣٣٣-٣٣-٣٣٣٣", "4111111111111111", "97.51.17.173",
]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    parts = ["4111111111111111", "10.1.2.3", "+1 (415) 555-0199", "2001-09-09", "078-05-1120", "me@example.org", " ", " ", ",", "-", ".", "é", "12", "x", "\n"]
    rows = [(i, t) for i, t in enumerate(TEXTS + ["".join(rnd.choices(parts, k=rnd.randrange(14))) for _ in range(300)])] + [(1, "dup 10.1.2.3"), (1, "dup 10.1.2.3"), (None, "10.1.2.3")]
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, n_card int, source string")
    out = pii.pseudonymize(df, KEY)
    assert out.columns == ["doc_id", "text", "source", *[f"n_{k}" for k in pii.KINDS]]
    got = sorted((tuple(r) for r in out.drop("source").collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert pii.pseudonymize(df.limit(0), KEY).count() == 0


def test_key_is_the_callers_or_the_sessions(spark):
    df = spark.createDataFrame([(1, "10.1.2.3")], "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymize(df)
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        assert pii.pseudonymize(df).first()["text"] == brute("10.1.2.3")[0] != pii.pseudonymize(df, "k2").first()["text"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_equal_values_stay_linked_and_valid(spark):
    cards = [c + str(-luhn(c + "0") % 10) for c in ("%015d" % (7 * i) for i in range(400))]
    df = spark.createDataFrame([(i, f"a {c} b") for i, c in enumerate(cards)] + [(999, f"{cards[3]}, again")], "doc_id long, text string")
    out = {r["doc_id"]: re.search(r"\d{16}", r["text"])[0] for r in pii.pseudonymize(df, KEY).collect()}
    assert out[3] == out[999] and len(set(out.values())) == 400
    assert all(luhn(x) % 10 == 0 for x in out.values()) and out[3] != cards[3]
