import datetime
import functools
import hashlib
import re

import pytest

from brindle.llm import pii

KEY = "test key"


def mixed(tag, left, right, a, b):
    for r in range(8):
        f = lambda x: int(hashlib.sha256(f"{KEY}|{tag}|{r}|{x}".encode()).hexdigest()[:15], 16)
        if r % 2 == 0:
            left = (left + f(right)) % a
        else:
            right = (right + f(left)) % b
    return left, right


def permuted(tag, d):
    u = len(d) // 2
    x, y = mixed(f"{tag}{len(d)}", int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
    return f"{x:0{u}d}{y:0{len(d) - u}d}"


def luhn(body):
    t = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        t += d - 9 * (d > 9)
    return str((10 - t % 10) % 10)


def filled(value, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def plain_date(v, shape, day):
    """Dates of the century that the format spells, leap days last, permuted."""
    century, leap = day.year // 100, day.year // 100 % 4 == 0
    parts = re.split(r"[./-]", v)
    if len(parts[0]) == 4 or (shape != "%m/%d/%Y" and len(parts[0]) == len(parts[1]) == 2):
        start = datetime.date(century * 100, 1, 1)
        a, b = (75, 487) if leap else (92, 397)
        x, y = mixed(f"date{century}", (day - start).days // b, (day - start).days % b, a, b)
        return (start + datetime.timedelta(x * b + y)).strftime(shape)
    cls = ("m" if shape == "%m/%d/%Y" else "d") + f"{len(parts[0])}{len(parts[1])}"
    every = spelled(cls, century)
    a, b = pii.DATE_CLASSES[cls][2 if leap else 1]
    x, y = mixed(f"date{cls}{century}", every.index(day) // b, every.index(day) % b, a, b)
    return text_of(every[x * b + y], cls, "." if "." in v else "/")


@functools.cache
def spelled(cls, century):
    days = [datetime.date(century * 100, 1, 1) + datetime.timedelta(k) for k in range(36525)]
    days = [d for d in days if d.year // 100 == century and pii.DATE_CLASSES[cls][0](d.month, d.day)]
    return sorted(days, key=lambda d: ((d.month, d.day) == (2, 29), d))


def text_of(d, cls, sep):
    numbers = (d.day, d.month) if cls[0] == "d" else (d.month, d.day)
    return sep.join([str(n) if k == "1" else f"{n:02d}" for n, k in zip(numbers, cls[1:], strict=True)] + [str(d.year)])


def plain(v):
    """The pseudonym of a candidate, written plainly."""
    digits = re.sub(r"\D", "", v)
    if "@" in v:
        return "user-" + hashlib.sha256(f"{KEY}|email|{v.lower()}".encode()).hexdigest()[:20] + "@example.invalid"
    if re.fullmatch(r"\d+(\.\d+){3}", v):
        o = [int(x) for x in v.split(".")]
        if max(o) > 255:
            return v
        x, y = mixed("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    for shape, rule in (("%Y-%m-%d", r"\d{4}-\d\d-\d\d"), ("%Y/%m/%d", r"\d{4}/\d\d/\d\d"), ("%d.%m.%Y", r"\d+\.\d+\.\d{4}"), ("%d/%m/%Y", r"\d+/\d+/\d{4}"), ("%m/%d/%Y", r"\d+/\d+/\d{4}")):
        if re.fullmatch(rule, v):
            try:
                day = datetime.datetime.strptime(v, shape).date()
            except ValueError:
                continue
            return plain_date(v, shape, day)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", v):
        area, group, serial = map(int, v.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return v
        x, y = mixed("ssn", (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 88902, 9999)
        area = x // 99
        return f"{area + (2 if area >= 665 else 1):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if v[0] == "+" or len(digits) == 10:
        if not 8 <= len(digits) <= 15:
            return v
        code = re.match(pii._COUNTRY, digits)[1] if v[0] == "+" else ""
        return filled(v, code + permuted("phone", digits[len(code) :]))
    if 13 <= len(digits) <= 19 and luhn(digits[:-1]) == digits[-1]:
        body = permuted("card", digits[:-1])
        return filled(v, body + luhn(body))
    return v


VALUES = [
    "nt.26@mail6.example.com", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "3782 822463 10005", "4111111111111112", "+1 (017) 555-7713",
    "+14155550123", "(415) 555-0123", "415-555-0123", "+44 20 7946 0958", "97.51.17.173", "256.1.1.1", "0.0.0.0", "123-45-6789", "666-12-1234", "899-99-9999", "665-01-0001",
    "667-01-0001", "1999-12-31", "1999-02-30", "2000-02-29", "29.02.2024", "29/02/2024", "12/31/1999", "1600/01/01", "2399-12-31",
    "1/2/2024", "3.4.1999", "03.4.1999", "3.04.1999", "29.2.2024", "29/2/1996", "2/29/1996", "02/29/2000", "7/31/1701", "31/12/1999", "+442079460958", "+44-20-7946-0958", "+353 1 234 5678", "+1 415 555 0123",
]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, row__ string")
    out = pii.pseudonymise(docs, KEY, findings=True)
    assert out.columns == ["doc_id", "text", "row__", "findings"]
    return {r.doc_id: r for r in out.collect()}


def test_values_against_plain_functions(spark):
    got = run(spark, [f"é {v}, x" for v in VALUES])
    for i, v in enumerate(VALUES):
        assert got[i].text == f"é {plain(v)}, x", v
        assert [f.value for f in got[i].findings] == ([v] if plain(v) != v else [])
        assert got[i]["row__"] == "kept"


def test_odd_texts_stay(spark):
    texts = [None, "", "no data", "version 1.2.3.4.5", "deadbeef4111111111111111", "a" * 300_000, "1" * 100_000, "a." * 100_000, "a@b", "x@" * 50_000, "1 " * 60_000]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i].text == t and got[i].findings == []


def test_several_in_one_text_and_links(spark):
    text = "4111111111111111 call +1 (017) 555-7713!! or 4111111111111111%%% on 1999-12-31."
    got = run(spark, [text, text])
    want = text
    for v in ("4111111111111111", "+1 (017) 555-7713", "1999-12-31"):
        want = want.replace(v, plain(v))
    assert got[0].text == got[1].text == want
    assert [f.kind for f in got[0].findings] == ["card", "phone", "card", "date"]


def test_permutations_have_no_collisions():
    assert len({permuted("phone", f"{i:04d}") for i in range(10_000)}) == 10_000
    assert len({mixed("date19", n // 397, n % 397, 92, 397) for n in range(36524)}) == 36524


def test_query_against_plain_functions(spark, llm_dir):
    from brindle.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{llm_dir}/documents.parquet").collect()}
    found = 0
    for r in queries.op5_pseudonyms(spark, llm_dir).collect():
        private = re.findall(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])", docs[r.doc_id])
        found += len(private)
        assert not [v for v in private if v in r.text]
        assert r.n_found >= len(private)
        if not re.search(r"\d", docs[r.doc_id]):
            assert r.text == docs[r.doc_id]
    assert found
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pseudonymise(empty, KEY).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        pii.pseudonymise(empty, KEY, text_col="absent").count()


def test_no_two_dates_of_a_format_share_a_pseudonym(spark):
    """All strings of every slash format in two centuries, and of every dot format in one."""
    strings = []
    for century, sep in ((19, "/"), (20, "/"), (19, ".")):
        for cls in pii.DATE_CLASSES:
            assert len(spelled(cls, century)) == (lambda f: f[0] * f[1])(pii.DATE_CLASSES[cls][2 if century % 4 == 0 else 1])
            if sep == "/" or cls[0] == "d":
                strings += [text_of(d, cls, sep) for d in spelled(cls, century)]
        start = datetime.date(century * 100, 1, 1)
        days = [start + datetime.timedelta(k) for k in range(36525)]
        strings += [f"{d:%d}{sep}{d:%m}{sep}{d.year}" for d in days if d.year // 100 == century]
    docs = spark.createDataFrame([(s,) for s in strings], "text string").repartition(8)
    got = {r.text for r in pii.pseudonymise(docs, KEY).collect()}
    assert len(strings) == len(set(strings)) > 250_000 and got == set(strings)


def test_phone_numbers_are_linked_in_any_grouping(spark):
    forms = ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "(415) 555-0123", "+1 415 555 0123", "+14155550123"]
    digits = [re.sub(r"\D", "", r.text) for _, r in sorted(run(spark, forms).items())]
    assert digits[0] == digits[1] == digits[2] != "442079460958" and digits[0].startswith("44")
    assert digits[4] == digits[5] == "1" + digits[3] != "14155550123"
