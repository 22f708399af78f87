"""Operators 3, 4, 6, 7, 8 and 10 against plain Python."""

import datetime
import hashlib
import os
import random
import re
import zlib

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tracery.llm import chat, htmltext, pii, quality
from tracery.llm.decontam import contamination, uncontaminated
from tracery.llm.mixing import mix_sources

# ------------------------------------------------------------------ chat


def test_escaping_is_reversible():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "a", "\n", "[", "]", "/INST]", "<", "é", " "]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        role = rng.choice(["user", "assistant", "system", "tool", "a]b\\", "[INST]", ""])
        pieces = chat.segments(role, text)
        whole = "".join(p for p, _ in pieces)
        assert chat.first_turn(whole + whole) == (role, text, len(whole)) and chat.first_turn(whole[:-1]) is None
        assert "".join(chat.unescaped(p) for p, loss in pieces if loss) == (text if role == "assistant" else "")


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "yes </s>"), (1, 0, "user", "[INST] hi"), (2, 0, "assistant", "x"), (2, 1, "assistant", None), (3, None, None, "odd"),
        (None, 0, "user", "n"), (None, 1, "assistant", "m"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a"), (4, 2, "assistant", "a"),
    ]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn int, role string, text string, conv string")
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0, str(r[2]), str(r[3]))):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert [got[c].valid for c in (1, 2, 3, None, 4)] == [True, False, False, True, False]
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_long_conversations_are_parsed_as_a_whole(spark):
    """Turns whose texts hold the template's own strings, a very long text, a long conversation."""
    rng = random.Random(8)
    bits = [b + a for b, a, _ in chat.TEMPLATE.values()] + [a for _, a, _ in chat.TEMPLATE.values()] + ["x", "\\", " </s>\n[INST] "]
    rows = [(1, i, ["user", "assistant"][i % 2], "".join(rng.choices(bits, k=rng.randint(0, 5)))) for i in range(3000)]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", " </s>\n" * 100_000)]
    out = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4))).collect()}
    for c, r in out.items():
        turns = [(x[2], x[3]) for x in rows if x[0] == c]
        assert r.n_turns == len(turns) and r.valid
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


# ------------------------------------------------------------------ mixing


def targets(sizes, weights, ratio=1.5, most=2):
    total, open_, out = ratio * sum(sizes), set(range(len(sizes))), {}
    while open_:
        rest = total - sum(out.values())
        level = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not full:
            return {**out, **{i: level * weights[i] for i in open_}}
        out.update({i: most * sizes[i] for i in full})
        open_ -= full
    return out


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["b", "a", "é", None, "", "z"]), "w " * rng.randint(0, 60)) for i in range(900)]
    rows += [(5000, "a", None), (5001, "b", ""), (5002, "z", "w\t  x" * 900), (None, "a", "w w"), (7, "a", "w w w"), (7, "a", "w w w")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    out = mix_sources(df, shard_words=500).collect()
    again = mix_sources(df.repartition(7), shard_words=500).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert len(out) == len(rows)
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    names = sorted({s for _, s, _ in rows if s is not None}) + [None]
    sizes = [sum(count(t) for _, x, t in rows if x == s) for s in names]
    want = targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    by_size = {sizes[i]: want[i] for i in range(len(names))}
    assert all(r.taken <= 2 * r.size and abs(r.target - by_size[r.source_size]) < 1e-6 for r in out)
    for size, target in by_size.items():
        assert abs(sum(r.taken for r in out if r.source_size == size) - target) <= 0.03 * target + 40
    assert mix_sources(df.limit(0)).count() == 0
    small = spark.createDataFrame([(1, "a", "w w w w")] + [(i, "b", "w " * 50) for i in range(2, 400)], "doc_id long, source string, text string")
    assert sum(r.taken for r in mix_sources(small).where("doc_id = 1").collect()) == 8 and [r.taken for r in mix_sources(small.where("doc_id = 1")).collect()] == [6]
    assert [r.taken for r in mix_sources(df.where("text is null")).collect()] == [0]


# ------------------------------------------------------------------ pages


def test_page_text(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
    <header><p>site</p></header><nav><ul><li><a href="/">home</a></ul></nav><div class="cookie-notice"><p>cookies</div><!-- <p>c</p> -->
    <article><div class="post-header"><h1>A&amp;B</h1></div><p>one<br>two  <b>three</b>&nbsp;x<p>four &lt;i&gt;</p><aside>side</aside><div class="ad"><p>buy</p></div>
    <table><tr><td>c1</td><td>c2</td></tr></table><section id="comments"><p>nice</p></section><form><input value="q"><p>name</p></form></article>
    <div id="sidebar"><p>links</p></div><footer>end</footer></body></html>"""
    # pages without an article: the site's lines go because the neighbours share them
    plain = "<body><p>Site name</p><p>{}</p><p>All rights</p></body>"
    rows = [
        (1, "https://a.example/x/1", page), (2, "https://a.example/x/2", page), (3, "https://b.example/p/1", plain.format("alpha")), (4, "https://b.example/p/2?u=1", plain.format("beta")),
        (5, None, None), (6, "", ""), (7, "no url", "<p>alone"), (8, "https://c.example/", "<p>unclosed <script>x"), (8, "https://c.example/", "plain &copy text"),
    ]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, salt int").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.page_text(df).collect())
    main = "A&B one two three x four <i> c1 c2"
    want = [(1, main), (2, main), (3, "alpha"), (4, "beta"), (5, ""), (6, ""), (7, "alone"), (8, "plain © text"), (8, "unclosed")]
    assert got == [(k, t, len(t)) for k, t in want]
    assert htmltext.page_text(df.limit(0)).count() == 0


def brute_page_text(rows):
    """Each page against its nearest neighbour, with all of a host's contents in one list."""
    def place(url):
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def digest(lines):
        return xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "little", signed=True) for x in htmltext.hashes_of(lines)))

    parsed = [(*place(u), htmltext.lines_of(h or "")) for _, u, h in rows]
    hosts = {}
    for host, path, lines in parsed:
        signed = (digest(lines) ^ (1 << 63)) - (1 << 63)
        old = hosts.setdefault(host, {}).get(signed, (path, lines))
        hosts[host][signed] = min(old, (path, lines), key=lambda x: x[0])
    out = []
    for (page, _, _), (host, _, lines) in zip(rows, parsed, strict=True):
        order = sorted((path, h, ls) for h, (path, ls) in hosts[host].items())
        k = next(i for i, x in enumerate(order) if x[1] == (digest(lines) ^ (1 << 63)) - (1 << 63))
        near = [order[i] for i in (k - 1, k + 1) if 0 <= i < len(order)]
        best = max(near, key=lambda x: len(os.path.commonprefix([x[0], order[k][0]]))) if near else None
        gone = htmltext.shared_lines([x[0] for x in lines], [x[0] for x in best[2]]) if best else set()
        marked = any(a and not m for _, a, m in lines)
        out.append((page, " ".join(x for i, (x, a, m) in enumerate(lines) if not m and (a if marked else i not in gone))))
    return out


@pytest.mark.parametrize("partitions", ["2", "13"])
def test_pages_against_brute_force(spark, partitions):
    """Large hosts, lone pages, copies, ties, pages with and without an article: the same for any partitioning."""
    rng = random.Random(12)
    site = {h: [f"{h} line {i}" for i in range(6)] for h in ("big", "mid")}
    rows = []
    for i in range(400):
        host = rng.choice(["big", "big", "big", "mid"])
        body = [f"<p>{x}</p>" for x in rng.sample(site[host], 4)] + [f"<p>own {rng.randrange(300)}</p>" for _ in range(rng.randint(0, 4))]
        rng.shuffle(body)
        if rng.random() < 0.2:
            body.insert(2, f"<article><h1>t {i}</h1><p>{site[host][0]}</p><object>kept</object></article>")
        rows.append((i, f"http://{host}.example/{rng.choice('abc')}/{rng.randrange(60)}", "<title>x</title><body>" + "".join(body)))
    rows += [(1000 + i, f"http://big.example/copy/{i}", rows[0][2]) for i in range(60)] + [(2000, "http://lone.example/", "<p>only <math>2</math>"), (2001, None, None), (2002, None, "<p>x")]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((r.page_id, r.text) for r in htmltext.page_text(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(brute_page_text(rows))
    assert dict(got)[2000] == "only" and any("line" not in t and t for _, t in got)


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        found = sorted(htmltext.shared_lines(a, b))
        rest = iter(b)
        assert len(found) == length[-1][-1] and all(a[i] in rest for i in found)


# ------------------------------------------------------------------ quality


def test_quality(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["the", "sea", "is", "calm", "and", "we", "sail"], k=rng.randint(20, 80))) for _ in range(300)]
    bad = [" ".join(w + "!!" for w in rng.choices(["BUY", "NOW", "FREE", "WIN"], k=rng.randint(20, 80))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 300)) for i in range(600)] + [(0, None), (None, 1), (9999, 1)]
    extra = [(1000, None), (1001, ""), (None, "calm sea"), (1002, "the sea " * 30_000), (3, good[3])]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows + extra], "doc_id long, text string, score double, y int").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.classify(df, lab).collect()
    assert len(out) == len(rows + extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id < 300) for r in held) / len(held) > 0.97
    kept = quality.accepted(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 600} == {r.doc_id for r in out if r.predicted and r.doc_id is not None and r.doc_id < 600}
    assert {r.score for r in quality.classify(df, lab.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality.classify(df, lab.where("quality = 0")).collect()} == {0}
    assert quality.classify(df.limit(0), lab).count() == 0


def test_held_out_labels_are_not_used(spark):
    rows = [(i, "a b c " * (i % 5 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1}
    one = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    other = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality.classify(df, one).collect() == quality.classify(df, other).collect()


# ------------------------------------------------------------------ private data


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms(spark):
    values = {
        "card": "4111111111111111", "ip": "10.0.255.7", "date": "2024-02-29", "ssn": "123-45-6789", "phone": "+1 (017) 555-7713",
        "token": "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "iban": "DE89370400440532013000", "day": "29.02.2024", "us": "12/31/1999", "uk": "31/12/1999", "mail": "jo.smith99@mail4.example.com", "MAIL": "JO7@X.ORG",
    }
    text = " ".join(f"{k}: {v};" for k, v in values.items())
    stay = "1234567890123456 666-12-3456 000-12-3456 123-00-4567 123-45-0000 300.1.1.1 2024-02-30 12345 v1.2.3.4.5 a1234567890123456 2024-13-01 user@ @host abc DE89370400440532013001 30.02.2024 13/13/2024"
    rows = [(1, text), (2, f"again {values['card']} {values['mail']}."), (3, stay), (4, None), (5, ""), (5, ""), (6, "x" * 100_000 + " 10.0.255.7")]
    df = spark.createDataFrame([(*r, "n", 9) for r in rows], "doc_id long, text string, note string, n_found int")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k1").collect()}
    assert pii.pseudonymise(df, "k1").count() == len(rows) and pii.pseudonymise(df, "k1").columns == ["doc_id", "text", "note", "n_found", "n_replaced"]
    new = dict(re.findall(r"(\w+): (.*?);", out[1].text))
    assert all(v not in out[1].text for v in values.values())
    shape = lambda s: re.sub("[0-9]", "9", s)
    assert len(new["card"]) == 16 and luhn(new["card"])
    assert shape(new["phone"]) == shape(values["phone"]) and shape(new["ssn"]) == shape(values["ssn"])
    assert all(0 <= int(x) < 256 for x in new["ip"].split(".")) and len(new["ip"].split(".")) == 4
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", new["date"]) and spark.sql(f"select try_cast('{new['date']}' as date) d").first().d is not None
    mod97 = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97
    assert re.fullmatch(r"DE\d{20}", new["iban"]) and mod97(new["iban"]) == 1
    day, month, year = new["day"].split(".")
    assert f"{year}-{month}-{day}" == new["date"]  # one day, two ways to write it
    assert new["us"].split("/") == [new["uk"].split("/")[k] for k in (1, 0, 2)]
    assert re.fullmatch("[0-9a-f]{40}", new["token"])
    assert re.fullmatch(r"[a-z0-9]{2}\.[a-z0-9]{7}@mail4\.example\.com", new["mail"]) and new["MAIL"].endswith("@X.ORG")
    assert out[2].text == f"again {new['card']} {new['mail']}."
    assert out[3].text == stay and out[3].n_replaced == 0
    assert (out[4].text, out[4].n_found, out[5].text) == (None, 0, "")
    assert out[6].text == "x" * 100_000 + " " + new["ip"]
    assert pii.pseudonymise(df, key="other").where("doc_id = 1").first().text != out[1].text
    with pytest.raises(ValueError):
        pii.pseudonymise(df, key="a'b")


def test_values_that_look_like_another_format(spark):
    """What fails one format is tried in the next; letters alone can be a secret; no name of a column matters."""
    secret, letters, mail, card = "AB12CDEF0123456789ABCDEF01234567", "deadbeef" * 4, "AB12CDEFGHIJKLM@x.org", "AB12 4111 1111 1111 1111"
    rows = [(1, f"{secret} {mail} {card}", 55, 1), (2, letters, 55, 1), (3, f"7 {letters}", 55, 1), (4, secret, 55, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_found int, _pii int")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k1", counts=False).collect()}
    assert all(x not in out[1].text for x in (secret, "AB12CDEFGHIJKLM", "4111 1111 1111 1111")) and out[1].text.endswith(card[:5] + out[1].text[-19:])
    assert out[2].text != letters and out[3].text == f"7 {out[2].text}" and out[1].text.startswith(out[4].text)
    assert all((r.n_found, r._pii) == (55, 1) for r in out.values())
    assert pii.pseudonymise(df, "k1").columns == ["doc_id", "text", "n_found", "_pii", "n_replaced"]


def feistel(x, high, low, tweak, key):
    left, right = divmod(x, low)
    f = lambda half, i: int(hashlib.sha256(":".join(map(str, [key, *tweak, i, half])).encode()).hexdigest()[:15], 16)
    for i in range(1, 11):
        if i % 2:
            left = (left + f(right, i)) % high
        else:
            right = (right + f(left, i)) % low
    return left * low + right


def plain_string(text, alphabet, tweak, key):
    base, out = len(alphabet), ""
    piece = next(n for n in range(15, 0, -1) if base**n < 2**53)
    for k in range((len(text) - 1) // piece + 1):
        p = text[k * piece : (k + 1) * piece]
        y = feistel(sum(alphabet.index(c) * base ** (len(p) - 1 - j) for j, c in enumerate(p)), base ** (len(p) // 2), base ** ((len(p) + 1) // 2), [*tweak, len(text), k], key)
        out += "".join(alphabet[y // base ** (len(p) - 1 - j) % base] for j in range(len(p)))
    return out


def test_feistel_against_plain_python(spark):
    """Cards, secrets, mail names, addresses, phones and dates of all texts of the smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    card = lambda m: (lambda b: b + next(d for d in "0123456789" if luhn(b + d)))(plain_string(m[:-1], pii.DIGITS, ["card"], "k1")) if luhn(m) else m
    day0 = datetime.date(1900, 1, 1)

    def address(m):
        q = [int(x) for x in m.split(".")]
        y = feistel(int.from_bytes(bytes(q), "big"), 65536, 65536, ["address"], "k1") if max(q) < 256 else None
        return m if y is None else ".".join(map(str, y.to_bytes(4, "big")))

    def date(m):
        d = (datetime.date.fromisoformat(m) - day0).days
        return str(day0 + datetime.timedelta(days=feistel(d, 250, 292, ["date"], "k1")))

    def phone(m):
        new = iter(plain_string(re.sub("[^0-9]", "", m), pii.DIGITS, ["phone"], "k1"))
        return "".join(next(new) if c.isdigit() else c for c in m)

    def mail(m):
        return re.sub("[A-Za-z0-9]+", lambda x: run(x[0]), m)

    def run(m):
        kind = next((a for r, a in (("[0-9]+", pii.DIGITS), ("[0-9a-z]+", pii.LOWER), ("[0-9A-Z]+", pii.UPPER)) if re.fullmatch(r, m)), pii.LOWER + pii.UPPER[10:])
        return plain_string(m, kind, ["mail"], "k1")

    forms = [(pii.FORMATS["number"], card), (pii.FORMATS["secret"], lambda m: plain_string(m, pii.DIGITS + ("ABCDEF" if re.search("[A-F]", m) else "abcdef"), ["secret"], "k1")), (pii.FORMATS["mail"], mail), (pii.FORMATS["address"], address), (pii.FORMATS["date"], date), (pii.FORMATS["phone"], phone)]
    seen = 0
    for new, old in zip(pii.pseudonymise(docs, "k1").orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        cut = [(m.start(), m.end(), m[0], f) for pattern, f in forms for m in regex.finditer(pattern, old.text or "")]
        text, at = "", 0
        for a, b, m, f in sorted(cut, key=lambda x: x[:2]):
            if a >= at:
                text, at, seen = text + old.text[at:a] + f(m), b, seen + 1
        if old.text is not None:
            assert text + old.text[at:] == new.text
    assert seen > 5


def test_permutation_of_a_format(spark):
    """All values of a small format have different pseudonyms, and all of them are used."""
    rows = spark.range(1000).select(F.format_string("%03d", "id").alias("d")).select("d", pii._string(F.col("d"), pii.DIGITS, ["t"], "k").alias("p")).collect()
    assert sorted(r.p for r in rows) == sorted(r.d for r in rows)


# ------------------------------------------------------------------ decontamination


def plain_contamination(docs, items, width=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    windows = {}
    for item, text in items:
        w = word.findall(low(text))
        if w and item is not None:
            n = min(width, len(w))
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = word.findall(low(text)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("broadcast_windows", [200_000, 0])
def test_contamination(spark, broadcast_windows):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(30)] + ["é", "Ünï"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(10, 30)))) for i in range(8)] + [(20, "t1 t2 t3"), (21, "unique!"), (22, ""), (23, None), (24, "t1 t2 t3"), (None, "t5"), (2, "t9 t8 t7 t6")]
    docs = []
    for i in range(60):
        w = words(rng.randint(0, 40))
        if rng.random() < 0.5:
            src = rng.choice(items)[1] or ""
            part = src.split()[rng.randint(0, 4) :][: rng.randint(5, 30)]
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((i, rng.choice([" ", ", ", "-"]).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "... !"), (103, "Unique"), (104, docs[3][1]), (104, docs[3][1]), (104, docs[4][1]), (None, "t1 T2, t3"), (105, "t1 " * 3000)]
    df = spark.createDataFrame([(*d, "w", 1, 2, 3) for d in docs], "doc_id long, text string, words string, item int, _i int, _t int").repartition(3)
    it = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in contamination(df, it, broadcast_windows=broadcast_windows).collect()]
    want = plain_contamination(docs, items)
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = uncontaminated(df, it)
    assert clean.columns == df.columns
    assert sorted((str(r.doc_id) for r in clean.collect())) == sorted(str(w[0]) for w in want if not w[5])
    assert not any(r.contaminated for r in contamination(df, it.limit(0)).collect())
    assert contamination(df.limit(0), it).count() == 0
