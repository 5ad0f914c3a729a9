"""Personal data to format-preserving pseudonyms, with SQL functions only.

Numbers and dates that pass their kind's validation are permuted within the kind's own domain
by a keyed Feistel network, so a pseudonym has the original's format and is valid again, and
equal values get equal pseudonyms in all documents. A value of domain size a * b is a pair
(x in Z_a, y in Z_b); even rounds add a keyed hash of y to x, odd ones a keyed hash of x to y.

  card   13 to 19 digits with a Luhn check digit: digits before it permuted, the check renewed
  ssn    3-2-4 digits in the issued ranges: permuted within those ranges
  ip     four octets: 2^32 addresses permuted
  phone  +country, (area) or 3-3-4 forms: all digits but the first permuted, signs in place
  date   calendar dates from 1800 to 2199 in three orders: the cycle's 146,097 days permuted
  email  not a finite format: a keyed digest of the lower-cased address in an address' form
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session setting that holds the key. There is no default: who knows the key can undo pseudonyms.
KEY_SETTING = "spark.ledgerloom.pii.key"
ROUNDS = 8

# fixed values: the patterns of candidates
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})"
SSN = r"\d{3}-\d{2}-\d{4}"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
PHONE = r"(?:(?:\+\d{1,3}[ -]?)?\(\d{3}\) ?\d{3}-\d{4}|\+\d{1,3}(?:[ -]?\d{2,4}){2,5}|\d{3}-\d{3}-\d{4})"
CARD = r"\d(?:[ -]?\d){12,18}"
NUMBER = r"(?<![\dA-Za-z+/.-])(?:" + "|".join((DATE, SSN, IP, PHONE, CARD)) + r")(?![\dA-Za-z]|[./-]\d)"

KINDS = ("email", "phone", "card", "ip", "ssn", "date")


def _hash(value: Column, tag: Column) -> Column:
    """A keyed hash of a value as a number below 2^60."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", tag, value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, tag: Column) -> Column:
    """struct<x, y>: the permuted pair of (x below a, y below b); tag names key, kind and tweak."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    rounds = F.array(*map(F.lit, range(ROUNDS)))

    def step(s, i):
        keyed = F.concat_ws("|", tag, i.cast("string"))
        even = F.struct(F.pmod(s["x"] + _hash(s["y"], keyed), a).cast("long").alias("x"), s["y"].alias("y"))
        odd = F.struct(s["x"].alias("x"), F.pmod(s["y"] + _hash(s["x"], keyed), b).cast("long").alias("y"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(rounds, start, step)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, tag: Column) -> Column:
    """A string of 2 to 36 digits permuted among the strings of its length."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    tagged = F.concat_ws("|", tag, F.length(digits).cast("string"))
    pair = feistel(F.substr(digits, F.lit(1), left), F.substr(digits, left + 1, right), _ten(left), _ten(right), tagged)
    return _with(pair, lambda p: F.concat(F.lpad(p["x"].cast("string"), left, "0"), F.lpad(p["y"].cast("string"), right, "0")))


def _with(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of digits with every second one from the right doubled and cast out by nine."""
    places = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(places, lambda d: d != ""), value), F.lit(0), lambda s, v: s + v)


def refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s, c):
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(m, r"(\d{3})-(\d{2})-(\d{4})", k).cast("int") for k in (1, 2, 3))


def _octets(m: Column) -> list[Column]:
    return [F.split_part(m, F.lit("."), F.lit(k)).cast("int") for k in (1, 2, 3, 4)]


def _date(m: Column) -> Column:
    whole = F.when(m.rlike(r"^\d{4}-"), m).otherwise(F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))))
    return F.try_to_timestamp(F.concat(whole, F.lit(" 00:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("date")


def kind_of(m: Column) -> Column:
    """The kind of a number candidate that passes its validation, else null."""
    area, group, serial = _ssn_parts(m)
    year = F.when(m.rlike(r"^\d{4}-"), F.substr(m, F.lit(1), F.lit(4))).otherwise(F.substr(m, F.lit(7), F.lit(4))).cast("int")
    whole = lambda p: m.rlike(f"^{p}$")
    n = F.length(digits_of(m))
    return (
        F.when(whole(DATE), F.when(year.between(1800, 2199) & _date(m).isNotNull(), "date"))
        .when(whole(SSN), F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), "ssn"))
        .when(whole(IP), F.when(F.greatest(*_octets(m)) <= 255, "ip"))
        .when(whole(CARD) & n.between(13, 19) & (luhn_sum(digits_of(m)) % 10 == 0), "card")
        .when(whole(PHONE) & n.between(8, 15), "phone")
    )


def _card(m: Column, tag: Column) -> Column:
    body = _with(digits_of(m), lambda d: permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), tag))
    checked = lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
    return refilled(m, _with(body, checked))


def _phone(m: Column, tag: Column) -> Column:
    new = lambda d: F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(F.substr(d, F.lit(2), F.length(d)), F.concat_ws("|", tag, F.substr(d, F.lit(1), F.lit(1)))))
    return refilled(m, _with(digits_of(m), new))


def _ip(m: Column, tag: Column) -> Column:
    a, b, c, d = _octets(m)
    pair = feistel(a * 256 + b, c * 256 + d, F.lit(65536), F.lit(65536), tag)
    part = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return _with(pair, lambda p: F.concat_ws(".", part(p["x"]), part(p["y"])))


def _ssn(m: Column, tag: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    pair = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), tag)
    new_area = lambda p: p["x"] + 1 + (p["x"] >= 665).cast("int")
    return _with(pair, lambda p: F.concat_ws("-", F.lpad(new_area(p).cast("string"), 3, "0"), F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["y"] % 9999 + 1).cast("string"), 4, "0")))


def _permuted_date(m: Column, tag: Column) -> Column:
    day = F.datediff(_date(m), F.lit("1800-01-01").cast("date"))
    pair = feistel(F.floor(day / 5411), day % 5411, F.lit(27), F.lit(5411), tag)  # 27 * 5411 = 146,097 days in 400 years
    new = _with(pair, lambda p: F.date_add(F.lit("1800-01-01").cast("date"), (p["x"] * 5411 + p["y"]).cast("int")))
    form = F.when(m.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(m.contains("/"), "dd/MM/yyyy").otherwise("dd.MM.yyyy")
    return _with(new, lambda d: F.when(form == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(form == "dd/MM/yyyy", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy")))


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    """The pseudonym of a candidate of a kind; candidates of no kind stay as they are."""
    tag = lambda k: F.lit(f"{key}|{k}")
    made = {"card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _permuted_date}
    out = F.when(kind.isNull(), m)
    for k, f in made.items():
        out = out.when(kind == k, f(m, tag(k)))
    return out.otherwise(m)


def email_pseudonym(m: Column, key: str) -> Column:
    hashed = F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(hashed, 1, 12), F.lit("@d"), F.substring(hashed, 13, 8), F.lit(".example"))


def _woven(gaps: Column, found: Column) -> Column:
    """The pieces between matches and the matches' replacements, put together again."""
    return F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


def session_key(spark: SparkSession) -> str | None:
    """The key that the session's configuration names, if it does."""
    return spark.conf.get(KEY_SETTING, None) or None


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with personal data in text replaced, and n_email .. n_date, how many of each kind.

    The key is the caller's or the session's (KEY_SETTING); without one it refuses. It is a literal
    in the plan: keep event logs and explained plans as safe as the key, or have Spark redact them.

    Null texts stay null with counts of 0; other columns stay as they are, but for any of the
    count columns' names, which are replaced. Repeated rows are each returned, empty texts stay empty, texts of
    any length are taken whole, and no rows give no rows. Addresses are
    replaced first, so their digits are not taken for numbers.
    """
    key = key or session_key(docs.sparkSession)
    if not key:
        raise ValueError(f"no key for pseudonyms: pass one or set {KEY_SETTING}")
    text = F.col("text")
    names = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS} | {"_mails", "_numbers"}]
    none = F.array().cast("array<string>")
    one = docs.select(*names, F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))).otherwise(none).alias("_mails"))
    mailed = F.when(F.size("_mails") > 0, _woven(F.split(text, EMAIL), F.transform("_mails", lambda m: email_pseudonym(m, key)))).otherwise(text)
    two = one.withColumn("text", mailed)
    candidates = F.when(text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))).otherwise(none)
    three = two.withColumn("_numbers", F.transform(candidates, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m"))))
    changed = F.when(F.size("_numbers") > 0, _woven(F.split(text, NUMBER), F.transform("_numbers", lambda s: pseudonym(s["kind"], s["m"], key)))).otherwise(text)
    count = lambda k: F.size(F.filter("_numbers", lambda s: s["kind"] == k)) if k != "email" else F.size("_mails")
    return three.select(*[changed.alias(c) if c == "text" else c for c in names], *[F.coalesce(F.greatest(count(k), F.lit(0)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS])
