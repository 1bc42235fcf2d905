import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from survista.llm import mixing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeat_words(w, size=5):
    n = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    cover = {j for k in range(len(w) - size + 1) if n[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
    return len(cover)


def test_counts_by_brute_force(docs):
    got = quality.counts(docs).select("text", *quality.COUNTS).collect()
    for r in got:
        t = r["text"] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), repeat_words(w))
        assert tuple(r)[1:7] == want, t[:60]


def test_votes_weigh_by_accuracy():
    """Two accurate rules and a coin: the estimates tell them apart."""
    rules = quality.RULES
    width = len(rules)
    vote = lambda a, c: (a, a, a, a, a, c)
    patterns = [(vote(1, 1), 450), (vote(1, -1), 450), (vote(-1, 1), 50), (vote(-1, -1), 50)]
    prior, right = quality.estimate(patterns)
    assert width == 6 and prior == pytest.approx(0.9, abs=0.02)
    assert right[0][0] > 0.98 and abs(right[5][0] - 0.5) < 0.05
    assert quality.posterior_of(vote(1, -1), prior, right) > 0.9 > 0.1 > quality.posterior_of(vote(-1, 1), prior, right)


def test_posterior_column_agrees(docs):
    j = quality.judge(docs)
    rows = j.select(*[f"v_{n}" for n in quality.RULES], "posterior").collect()
    found = sorted(Counter(tuple(r)[:-1] for r in rows).items())
    prior, right = quality.estimate(found)
    for r in rows:
        assert r["posterior"] == pytest.approx(quality.posterior_of(tuple(r)[:-1], prior, right), rel=1e-9)


def test_good_documents_keep_columns(docs, no_docs):
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("posterior", F.lit(1))
    got = quality.good_documents(clash)
    assert got.columns == clash.columns and {r["n_words"] for r in got.collect()} == {"mine"}
    assert quality.good_documents(no_docs).count() == 0


def test_long_text_is_counted_whole(spark):
    words = [f"w{k % 50_000}" for k in range(120_000)]
    (r,) = quality.counts(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")).collect()
    assert (r["n_words"], r["n_distinct"], r["n_repeat_words"]) == (120_000, 50_000, 120_000)


def brute_targets(sizes, epochs=3, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(epochs * sizes[s]) for s in over}


def test_mix_reaches_targets(docs):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02, abs=20)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_sources_of_every_size(spark, no_docs):
    """From one word to ten million: half a block off the target at most."""
    sizes = {"a": 10_000_000, "b": 800, "c": 2000, "d": 10_000, "e": 1, "f": 30, "g": 123_457, "h": 7, None: 99}
    rows = [(k, "w " * n, None, s, None) for k, (s, size) in enumerate(sizes.items()) for n in [size // 5] * 5 + [size % 5]]
    taken = Counter()
    for r in mixing.mix(spark.createDataFrame(rows, no_docs.schema)).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    want = brute_targets(sizes)
    for s, size in sizes.items():
        blocks = max(-(-size // mixing.BLOCK), min(size, mixing.PARTS))
        assert abs(taken[s] - want[s]) <= size / blocks / 2 + 2, s
        assert want[s] < 50 or taken[s] == pytest.approx(want[s], rel=0.01), s


def test_slots_are_spread(spark, no_docs):
    """Any stretch of the mix has a source in about its share."""
    sizes = {"a": 40_000, "b": 5000, "c": 900}
    rows = [(k, "w " * n, None, s, None) for k, (s, n) in enumerate(sizes.items())]
    sized = spark.createDataFrame(rows, no_docs.schema).selectExpr("source", "cast(length(text) / 2 AS bigint) AS size")
    per = mixing.targets(sized).collect()
    n = sum(r["slots"] for r in per)
    slots = sorted(mixing.schedule(mixing.targets(sized), n).collect())
    assert len(slots) == n == len({r["slot"] for r in slots})
    for r in per:
        own = [s for s in slots if s["source_no"] == r["source_no"]]
        assert [s["rank"] for s in own] == list(range(r["slots"])) and all(s["block"] == s["rank"] % r["blocks"] for s in own)
        for lo in range(0, n - 60, 60):
            got = sum(s["source_no"] == r["source_no"] for s in slots[lo : lo + 60])
            assert abs(got - 60 * r["slots"] / n) <= 10


def test_ties_and_repeated_rows(spark, no_docs):
    """Rows of one doc_id and size are documents of their own; reruns agree whatever the order of rows."""
    rows = [(k % 3, "a b c d", None, "s", None) for k in range(12)] + [(7, "x y " * 400, None, "big", None)] * 2 + [(None, "n o", None, None, None)] * 5
    show = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["source"] or "", r["taken"]) for r in mixing.mix(df).collect())
    first = show(spark.createDataFrame(rows, no_docs.schema))
    assert len(first) == len(rows) and first == show(spark.createDataFrame(rows[::-1], no_docs.schema).repartition(4))
    assert all(t <= 3 * n for _, _, n, _, t in first)


def test_mix_edges(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], no_docs.schema)
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(empty).collect()] == [(0, 0, 0.0)] * 2


def test_mixed_documents(docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    n = Counter(r["doc_id"] for r in got.collect())
    assert max(n.values()) <= 6  # a repeated row is taken for each of its rows
    assert sum(1 for _ in n) > 0


def test_van_der_corput(spark):
    got = [r[0] for r in spark.range(8).select(mixing.van_der_corput(F.col("id"), 3)).collect()]
    assert got == [0, 4, 2, 6, 1, 5, 3, 7]


CASES = [
    "mail Foo.49@mail9.example.com and FOO.49@MAIL9.EXAMPLE.COM, +1 (729) 555-7725 or 729-555-7725.", "card 4111 1111 1111 1111 x 4111111111111111, ip 83.229.25.121, ssn 123-45-6789",
    "Mrs. Jane Smith met Mr Smith and Frau Анна Иванова at DE44 5001 0517 5407 3249 31.", "nothing 12 here", None, "", "foo.49@mail9.example.com again", "Dr Smith",
]


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_surrogates(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(CASES)], "doc_id bigint, text string, n_entities string")
    got = {r[0]: (r[1], r[2], r[3]) for r in pii.replace_entities(df).collect()}
    t = {k: v[0] for k, v in got.items()}
    assert t[3] == CASES[3] and t[4] is None and t[5] == "" and got[3][1] == "x"
    for gone in ("foo.49", "83.229.25.121", "123-45-6789", "729", "4111111111111111", "Jane", "Smith", "Анна", "Иванова", "5001 0517"):
        assert not any(gone.lower() in (v or "").lower() for v in t.values()), gone
    low, high = re.findall(r"\S+@\S+[a-zA-Z]", t[0])
    assert low.upper() == high and low in t[6] and low.endswith(".example.com")
    (country, long), (_, short) = re.findall(r"(\+1 )?\(?(\d{3}\)?[ -]555-\d{4})", t[0])
    assert country and re.sub(r"\D", "", long) == re.sub(r"\D", "", short)
    spaced, joined = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", t[1])
    assert spaced.replace(" ", "") == joined and luhn(joined) % 10 == 0
    assert all(0 <= int(o) < 256 for o in re.search(r"ip (\S+),", t[1])[1].split("."))
    name = re.match(r"Mrs\. (\w+) (\w+) met Mr (\w+) and Frau (\w+) (\w+) at DE\d\d(?: \d{4}){4} \d\d\.$", t[2])
    assert name and name[2] == name[3] and name[1].endswith("na") and re.fullmatch("[А-я]+", name[4]) and t[7] == f"Dr {name[2]}"


def test_collisions_are_drawn_again(spark):
    """Far more names than one draw has surrogates for."""
    keys = spark.range(6000).select(F.lit("m").alias("kind"), F.concat(F.lit("Q"), F.col("id").cast("string")).alias("canon"))
    got = pii.assign(keys).collect()
    assert len(got) == 6000 and len({r["surrogate"] for r in got}) == 6000
    assert not {r["surrogate"] for r in got} & {r["canon"] for r in got}


def test_addresses_of_any_script(spark):
    """No letter of any script stays in a local part, and each attempt draws anew."""
    local = ["李明", "محمد", "דוד", "김민준", "สมศักดิ์", "łőßżć", "ёјћ", "άέ", "𠮷田", "אב٣٤", "գևոր", "राहुल"]
    df = spark.createDataFrame([(k, f"to {x}@example.com now") for k, x in enumerate(local)], "doc_id bigint, text string")
    for r in pii.replace_entities(df).collect():
        new = re.fullmatch(r"to ([^@]+)@[a-z]+\.com now", r["text"])
        assert new and r["n_entities"] == 1 and sum(a == b for a, b in zip(new[1], local[r["doc_id"]], strict=True)) < len(local[r["doc_id"]])
    host = [("email", f"{x}@例子.公司") for x in ["用户", "_"]]
    drawn = spark.createDataFrame(host, "kind string, canon string").crossJoin(spark.range(9).select(F.col("id").cast("int").alias("attempt")))
    got = drawn.withColumn("to", pii.surrogate(pii.KEY)).collect()
    assert all(r["to"] != r["canon"] for r in got if r["attempt"] >= pii.PATIENCE) and len({r["to"] for r in got if r["canon"] == host[0][1]}) == 9


def test_more_addresses_than_letters(spark):
    """One-letter addresses of a host, more than its script has letters here."""
    keys = spark.createDataFrame([("email", f"{chr(0x4E00 + k)}@例子.公司") for k in range(150)], "kind string, canon string")
    got = pii.assign(keys).collect()
    assert len({r["surrogate"] for r in got}) == 150 and not {r["surrogate"] for r in got} & {r["canon"] for r in got}


def test_names_refer_alike(spark):
    """A name after a neutral form of address goes by its gender elsewhere, and bare words of a name in the same text go along."""
    texts = ["Ms Jane Smith-Jones spoke. Later Jane and Smith-Jones’s friend O'Neil left; janet stayed.", "Dr Jane Smith-Jones again", "Jane alone is no entity", "Prof. Kim O'Neil, O'Neil's own"]
    got = {r[0]: r[1] for r in pii.replace_entities(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")).collect()}
    m = re.fullmatch(r"Ms (\w+) (\w+) spoke. Later (\w+) and (\w+)’s friend O'Neil left; janet stayed.", got[0])
    assert m and m[1] == m[3] != "Jane" and m[2] == m[4] and m[1].endswith("na")
    assert got[1] == f"Dr {m[1]} {m[2]} again" and got[2] == texts[2]
    k = re.fullmatch(r"Prof. (\w+) (\w+), (\w+)'s own", got[3])
    assert k and k[2] == k[3]


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_bank_numbers_keep_their_check(spark):
    texts = ["DE44 5001 0517 5407 3249 31", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606", "DE00 5001 0517 5407 3249 31"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    for r in pii.replace_entities(df).collect():
        old, new = (t.replace(" ", "") for t in (texts[r[0]], r["text"]))
        assert new != old and new[:2] == old[:2] and len(new) == len(old) and mod97(new) == mod97(old)


def test_numbers_grow_when_taken(spark, monkeypatch):
    """More numbers of a form than it has surrogates: 80,000 for five digits."""
    keys = spark.range(95_000).select(F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), 5, "0").alias("canon"))
    got = pii.assign(keys).agg(F.count(F.lit(1)), F.count_distinct("surrogate"), F.max(F.length("surrogate"))).first()
    assert got[0] == got[1] == 95_000 and got[2] > 5
    with pytest.raises(ValueError, match="no free surrogate"):
        monkeypatch.setattr(pii, "ATTEMPTS", 0)
        pii.assign(keys.limit(3000))


def test_mentions_map_one_to_one(spark):
    """Many entities of all kinds: mentions agree, different entities stay different, forms stay, originals go."""
    rng = random.Random(6)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = {
        "mail": lambda: f"{rng.choice(['ann', 'bob', 'éva'])}.{digit(2)}@m{digit(1)}.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "ssn": lambda: f"{digit(3)}-{digit(2)}-{digit(4)}",
        "phone": lambda: f"+4{digit(1)} {rng.randrange(2, 10)}{digit(2)} {digit(3)} {digit(4)}", "card": lambda: f"{rng.randrange(3, 7)}{digit(3)} {digit(4)} {digit(4)} {digit(4)}",
    }
    pool = [(k, f()) for k, f in make.items() for _ in range(40)]
    texts = [" ; ".join(e for _, e in rng.sample(pool, 6)) for _ in range(150)]
    kind = {e: k for k, e in pool}
    got = {r[0]: r[1] for r in pii.replace_entities(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")).collect()}
    to = {}
    form = lambda e: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", e)))
    for k, t in enumerate(texts):
        for old, new in zip(t.split(" ; "), got[k].split(" ; "), strict=True):
            assert to.setdefault(old, new) == new and new not in kind, (old, new)
            assert kind[old] in ("ip", "mail") or form(old) == form(new), (old, new)
    for k in make:
        canon = (lambda e: re.sub(r"\D", "", e)[-10:]) if k == "phone" else (lambda e: e)
        mine = {canon(o): canon(n) for o, n in to.items() if kind[o] == k}
        assert len(set(mine.values())) == len(mine) > 20, k


def test_repeated_and_long_texts(spark):
    long = "mail a.b@c.example.com " + "word " * 200_000 + "a.b@c.example.com"
    got = [r["text"] for r in pii.replace_entities(spark.createDataFrame([(1, long), (1, long), (2, "a.b@c.example.com")], "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[0].split()[1] == got[0].split()[-1] == got[2] != "a.b@c.example.com" and len(got[0].split()) == 200_003


def test_pii_of_nothing(no_docs):
    assert pii.replace_entities(no_docs).count() == 0


def test_posterior_is_bounded():
    assert 0 <= quality.posterior_of((-1,) * 6, 0.5, [(1 - 1e-16, 1 - 1e-16)] * 6) <= 1 and math.isfinite(quality.weights_of(0.5, [(0.9, 0.9)] * 6)[0])
