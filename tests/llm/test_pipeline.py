"""The pipeline: every stage on its predecessor's rows, against plain versions of its decision."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from cairn.llm import quality_rules, registry
from llm_tables import SCHEMA, documents

NAMES = ["quality_rules", "language_id", "ngram_jaccard_join", "suffix_array_dedup", "packing"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_failed(text):
    words = words_of(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def shingles(text):
    words = words_of(text)
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def without_repeats(texts, span):
    raws = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(r[k:k + span] for r in raws.values() for k in range(len(r) - span + 1))
    out = {}
    for i, r in raws.items():
        covered = bytearray(len(r))
        for k in range(len(r) - span + 1):
            if seen[r[k:k + span]] > 1:
                covered[k:k + span] = b"\1" * span
        out[i] = bytes(b for b, c in zip(r, covered) if not c).decode("utf-8", "ignore")
    return out


def test_every_stage_against_a_plain_version(spark, table, tmp_path):
    docs, sf = table("documents"), "/root/testdata/sf0.01"
    assert [n for n, _ in cp.STAGES] == NAMES
    steps = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps.append({r.doc_id: r.text for r in docs.collect()})
        assert steps[-1].keys() <= steps[-2].keys() and len(steps[-1]) == docs.count()
    start, good, known, single, cut = steps
    assert all(start[i] == good[i] for i in good) and all(good[i] == single[i] for i in single)

    # quality: what fails the base counts goes, and nothing else that the operator itself would keep
    verdict = {r.doc_id: r.kept for r in quality_rules.digest(table("documents"), table("labels")).collect()}
    assert not any(base_failed(t) for t in good.values())
    assert {i for i in start if verdict[i]} <= set(good)
    labels = {r.doc_id: r.quality for r in table("labels").collect()}
    sound = [i for i in start if labels.get(i) == 1 and not base_failed(start[i])]
    assert sum(i in good for i in sound) >= 0.95 * len(sound)

    # language: texts with letters stay almost all
    assert not any(any(ch.isalpha() for ch in good[i]) for i in set(good) - set(known)) or len(known) >= 0.98 * len(good)
    assert all(any(ch.isalpha() for ch in t) for t in known.values())

    # near copies: no two documents that stay are at 0.8 or more, and every one that went is near to another
    sets = {i: shingles(t) for i, t in known.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    near = defaultdict(set)
    for i, s in sets.items():
        common = Counter(j for g in s for j in holders[g] if j != i)
        near[i] = {j for j, n in common.items() if 9 * n >= 4 * (len(s) + len(sets[j]))}
    assert not any(near[i] & single.keys() for i in single)
    assert all(near[i] for i in known.keys() - single.keys())

    # repeats: judged on the stage's input, and no passage of over 50 words is left twice
    assert cut == {i: t if (t or "").encode() == want.encode() else want for (i, t), want in zip(single.items(), without_repeats(single, cp.PASSAGE_BYTES).values())}
    fifty = Counter(g for t in cut.values() for g in {tuple(w) for w in zip(*[words_of(t)[k:] for k in range(51)])})
    assert len(single) > 500 and max(fifty.values()) == 1
    untouched = [i for i in single if cut[i] == single[i]]
    assert len(untouched) > 0.8 * len(single)

    pieces = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == set(cut)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_on_empty_and_odd_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = "the quick brown fox " + " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (1, text), (None, text + " end"), (3, None), (4, ""), (5, "1 2 3")]
    for k, docs in enumerate((documents(spark, rows, clashes=True), spark.createDataFrame([], SCHEMA))):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        assert {r.doc_id for r in docs.collect()} == ({1} if k == 0 else set())


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and set(registry.queries()) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
