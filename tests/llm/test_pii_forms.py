"""Grouped, international and timed forms of private data."""

import re

from pyspark.sql import functions as F

from tracery.llm import pii


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def test_forms(spark):
    values = {
        "card": "4111111111111111", "spaced": "4111 1111 1111 1111", "dashed": "4111-1111-1111-1111", "amex": "3782 822463 10005", "amexone": "378282246310005",
        "iban": "DE89370400440532013000", "ibans": "DE89 3704 0044 0532 0130 00", "four": "AT61 1904 3002 3457 3201",
        "time": "2024-01-02T10:00:00", "iso": "2024-01-02", "slash": "2024/01/02", "dot": "2024.01.02", "dash": "01-02-2024", "late": "31-12-2023",
        "us": "+15551234567", "uss": "+1 555 123 4567", "uk": "+44 20 7946 0958", "de": "+49 30 1234567", "deg": "+49 (30) 123-4567",
    }
    text = " ".join(f"{k}: {v};" for k, v in values.items())
    run = "no 1234 4111 1111 1111 1111 123, AT61 1904 3002 3457 3201 BANK"
    stay = "4111 1111 1111 1112 DE89 3704 0044 0532 0130 01 2024/13/01 31-31-2023 1 + 23456 or 2024-01-02-03"
    df = spark.createDataFrame([(1, text), (2, run), (3, stay)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k1").collect()}
    new = dict(re.findall(r"(\w+): (.*?);", out[1].text))
    assert out[1].n_found == out[1].n_replaced == len(values)
    assert all(new[k] != v for k, v in values.items())
    shape = lambda s: re.sub("[0-9]", "9", s)
    assert all(shape(new[k]) == shape(v) for k, v in values.items())
    assert luhn(new["card"]) and luhn(new["amexone"])
    assert new["card"] == digits(new["spaced"]) == digits(new["dashed"]) and digits(new["amex"]) == new["amexone"]
    assert new["ibans"].replace(" ", "") == new["iban"]
    mod97 = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97
    assert mod97(new["iban"]) == mod97(new["four"].replace(" ", "")) == 1
    assert new["time"] == new["iso"] + "T10:00:00" and new["slash"].replace("/", "-") == new["dot"].replace(".", "-") == new["iso"]
    year, month, day = new["iso"].split("-")
    assert new["dash"] == f"{month}-{day}-{year}"
    assert digits(new["us"]) == digits(new["uss"]) and digits(new["de"]) == digits(new["deg"])
    assert out[2].text == f"no 1234 {new['spaced']} 123, {new['four']} BANK"
    assert out[3].text == stay and out[3].n_replaced == 0


def test_long_runs_take_linear_time(spark):
    """Five million characters that might all begin a mail name are read once."""
    import time

    texts = [("a." * 2_500_000,), ("1 " * 1_000_000 + "@",), ("x@" * 500_000 + "y.z",), ("a.b+c@d.ef " * 20_000,)]
    began = time.time()
    out = pii.pseudonymise(spark.createDataFrame(texts, "text string"), "k1").select(F.length("text").alias("n"), "n_found").collect()
    assert sorted((r.n, r.n_found) for r in out) == sorted([(5_000_000, 0), (2_000_001, 0), (1_000_003, 1), (220_000, 20_000)])
    assert time.time() - began < 120


def test_mail_names_with_dots_keep_their_parts_linked(spark):
    """Each run of a mail name has one pseudonym, wherever it stands."""
    rows = [("first.last@ex.org",), ("last.first@ex.org",), ("(first@ex.org)",)]
    a, b, c = (r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "text string"), "k1").collect())
    one, two = a.removesuffix("@ex.org").split(".")
    assert b == f"{two}.{one}@ex.org" and c == f"({one}@ex.org)" and (one, two) != ("first", "last")
