import re
from collections import Counter

import pytest
from test_ops_free import brute_components
from test_ops_native import brute_targets, repeat_words

import corpus_pipeline as P
from survista.llm import mixing, packing, pii, quality


def test_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept[name] = docs.collect()
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "packing"]
    ids = {n: Counter(r["doc_id"] for r in rows) for n, rows in kept.items()}
    assert set(ids["near_duplicates"]) <= set(ids["quality_rules"]) and max(ids["near_duplicates"].values()) == 1
    assert set(ids["personal_data"]) == set(ids["near_duplicates"]) and set(ids["mixing"]) <= set(ids["personal_data"])
    assert max(ids["mixing"].values()) <= 3
    assert sum(r["piece"] == 0 for r in kept["packing"]) == len(kept["mixing"])


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).where("length <= 0").count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(rows):
    """Rows whose posterior is a half or more, from counts taken one text at a time."""
    votes = []
    for r in rows:
        t = r["text"] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        have = dict(zip(quality.COUNTS, (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), repeat_words(w), len(re.findall(r"(?<![^\W\d_])[A-Z]{3,}(?![^\W\d_])", t)), len(set(w))), strict=True))
        ask = lambda rule, have=have: eval(rule.replace(" AND ", " and ").replace(" = ", " == "), {}, have)  # noqa: E731, S307
        votes.append(tuple(-1 if ask(no) else 1 if ask(yes) else 0 for no, yes in quality.RULES.values()))
    prior, right = quality.estimate(sorted(Counter(votes).items()))
    return [r for r, v in zip(rows, votes, strict=True) if quality.posterior_of(v, prior, right) >= quality.THRESHOLD]


def brute_mix(rows):
    """How often each row is taken: blocks of each source in the order of the keys, slots by mirrored numbers."""
    import hashlib

    size = lambda r: len(WORD.findall(r["text"] or ""))
    sources = Counter()
    for r in rows:
        sources[r["source"]] += size(r)
    want, out, parts, low = brute_targets(sources), Counter(), [], 0
    for s in sorted(sources, key=lambda s: (s is None, s or "")):
        blocks = max(-(-sources[s] // mixing.BLOCK), min(sources[s], mixing.PARTS))
        n = int(round(want[s] / sources[s] * blocks, 6) + 0.5) if sources[s] else 0
        parts.append((s, blocks, n, low))
        low += n
    bits = max(1, (low - 1).bit_length())
    for s, blocks, n, low in parts:
        ranked = sorted(range(low, low + n), key=lambda v: int(f"{v:0{bits}b}"[::-1], 2))
        times = Counter(k % blocks for k, _ in enumerate(ranked))
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()  # noqa: E731, S324
        order = sorted((md5(f"mix:{'null' if r['doc_id'] is None else r['doc_id']}"), r["doc_id"] is not None, r["doc_id"] or 0, size(r), md5(r["text"] or "") if r["doc_id"] is None else "", k) for k, r in enumerate(rows) if r["source"] == s)
        at = 0
        for _, _, _, n_words, _, k in order:
            taken = sum(times[b] * (min(at + n_words, (b + 1) * sources[s] // blocks) - max(at, b * sources[s] // blocks)) for b in range(blocks) if (b + 1) * sources[s] // blocks > at and b * sources[s] // blocks < at + n_words) if n_words else 0
            copies = int(taken / max(n_words, 1) + 0.5)
            if copies:
                out[(rows[k]["doc_id"], rows[k]["text"])] += copies
            at += n_words
    return out


def test_stages_by_brute_force(spark, docs):
    """Each stage on its own input, against plain Python."""
    import public_tokenizers

    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    stages, show = dict(P.STAGES), lambda rows: sorted((r["doc_id"], r["text"] or "", r["source"] or "") for r in rows)
    frame = lambda rows: spark.createDataFrame(rows, docs.schema)
    good = brute_quality(rows)
    assert show(stages["quality_rules"](spark, frame(rows), "").collect()) == show(good) and 0 < len(good) < len(rows)
    component = brute_components([(r["doc_id"], r["text"]) for r in good], 5, 80)
    first = [r for r in good if component[r["doc_id"]][1] == r["doc_id"]]
    assert show(stages["near_duplicates"](spark, frame(good), "").collect()) == show(first) and len(first) < len(good)
    plain = {r["doc_id"]: r["text"] for r in first}
    private = [r.asDict() | {"text": (r["text"] or "") + (f" mail a{k % 3}@x{k % 2}.example.com" if k % 4 == 0 else "")} for k, r in enumerate(first)]
    clean = stages["personal_data"](spark, frame([tuple(r.values()) for r in private]), "").collect()
    seen = {}
    for r in clean:
        before = next(p["text"] for p in private if p["doc_id"] == r["doc_id"])
        found = re.search(r" mail (\S+@\S+)$", before)
        if not found:
            assert r["text"] == before
            continue
        now = re.fullmatch(re.escape(plain[r["doc_id"]] or "") + r" mail ([a-z]\d@[a-z]\d\.example\.com)", r["text"])
        assert now and r["n_chars"] == len(r["text"]) and seen.setdefault(found[1], now[1]) == now[1] != found[1]
    assert len(set(seen.values())) == len(seen) > 1 and pii.KEY
    got = Counter((r["doc_id"], r["text"]) for r in stages["mixing"](spark, frame(first), "").collect())
    assert got == brute_mix(first)
    table = packing.words(public_tokenizers.path(packing.VOCABULARY))
    packed = stages["packing"](spark, frame(first), "").collect()
    lengths = {r["doc_id"]: len(table.whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in first}
    have = Counter()
    for r in packed:
        have[r["doc_id"]] += r["length"]
    assert have == lengths and len({r["sequence_id"] for r in packed}) == packing.lower_bound([*lengths.values()], packing.CAPACITY)


def test_nothing(spark, no_docs):
    """An empty table goes through all stages."""
    df = no_docs
    for _, stage in P.STAGES:
        df = stage(spark, df, "")
        assert df.count() == 0
        if "piece" not in df.columns:
            assert df.columns == no_docs.columns


def test_more_columns(spark, docs):
    """Columns called like those that stages make stay as they are."""
    df = docs.withColumnsRenamed({"lang": "posterior"}).selectExpr("*", "'k' AS n_words", "doc_id AS component_id", "'e' AS n_entities", "7 AS taken", "'s' AS size")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        assert {(r["n_words"], r["n_entities"], r["taken"], r["size"]) for r in out.collect()} == {("k", "e", 7, "s")}, name


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "personal_data", "mixing", "packing"])
def test_stage_names(name):
    assert name in dict(P.STAGES)
