"""The pipeline's stages, each judged on its own input against brute force over planted documents."""

import base64
import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import LOWER, near_components  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def planted():
    random.seed(21)
    plain, foul = [f"word{i}" for i in range(3000)], [f"foul{i}" for i in range(25)]
    said = lambda n, words=plain: " ".join(random.choice(words) for _ in range(n)) + "."
    items = [said(30) for _ in range(6)]
    texts: dict[int, tuple[str | None, str]] = {}
    for i in range(300):
        toxic = i % 5 == 0
        texts[i] = (said(70) if not toxic else " ".join(random.choice(foul if k % 3 == 0 else plain) for k in range(70)), "toxic" if toxic else "clean")
    for i in range(300, 320):
        texts[i] = (said(40) + "\n" + random.choice(items) + "\n" + said(20), "leak")
    for i in range(320, 350):
        base = texts[random.choice([x for x in range(300) if texts[x][1] == "clean"])][0].split()
        for _ in range(random.choice([0, 1, 2, 3])):
            base[random.randrange(len(base))] = random.choice(plain)
        texts[i] = (" ".join(base), "copy")
    for i, t in enumerate(["", None, "too short", "BUY!! NOW!! " * 20, "Home | About | Login\n" * 30, "same line of five words here\n" * 40]):
        texts[350 + i] = (t, "junk")
    texts[360] = (said(20000), "clean")
    rows = [(i, t, "en", "s", len(t or "")) for i, (t, _) in texts.items()]
    rows += [rows[3], (None, texts[1][0], "en", "s", 1), (2, said(50), None, None, None)]  # repeated row, no id, one id with another text
    return rows, texts, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, texts, items = planted()
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, int(kind == "toxic")) for i, (_, kind) in texts.items() if i < 300]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "")], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_failed(text):
    words = words_of(text)
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {p for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_stages(spark, folder):
    from lattica.llm.common import materialize

    rows, texts, items = planted()
    kind = {i: k for i, (_, k) in texts.items()}
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("score", F.lit("clash"))
    seen = [[(r["doc_id"], r["text"]) for r in docs.collect()]]
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name.replace(" ", "-"))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == pipeline.COLUMNS
            assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect() if name == "quality rules")
            seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert list(stages) == ["toxicity", "quality rules", "near-duplicates", "decontamination", "byte-level BPE"]
    start, after_toxic, after_quality, after_near, after_leaks = seen

    assert collections.Counter(after_toxic) == collections.Counter(x for x in start if kind.get(x[0]) != "toxic")
    # Clean lines pass whole here, so a document is kept as it is or rejected.
    want = [x for x in after_toxic if not base_failed(x[1]) and kind.get(x[0]) != "junk"]
    assert collections.Counter(after_quality) == collections.Counter(want)
    groups = near_components(after_quality, 5)
    want = collections.Counter((d, t) for (d, t, _, least), n in groups.items() for _ in range(n) if d is None or d == least)
    assert collections.Counter(after_near) == want and sum(want.values()) < len(after_quality) - 10
    # Equal ids, repeated rows: the row that stands twice stays twice, the id with two texts keeps what no other document has.
    assert sum(x[0] == 3 for x in after_near) == 2 and sum(x[0] == 2 for x in after_near) == 2 and None in {x[0] for x in after_near}

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(w[k : k + 10]) for w in map(split, items) for k in range(len(w) - 9)}
    leaked = lambda t: any(tuple(split(t)[k : k + 10]) in windows for k in range(len(split(t)) - 9))
    assert collections.Counter(after_leaks) == collections.Counter(x for x in after_near if not leaked(x[1]))
    assert any(kind.get(x[0]) == "leak" for x in after_near) and not any(kind.get(x[0]) == "leak" for x in after_leaks)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in docs.collect())
    assert got == collections.Counter((d, tuple(tk.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in after_leaks)


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
