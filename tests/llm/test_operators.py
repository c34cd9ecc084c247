"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from lattica.llm import bpe, chat, decontam, html_extract, neardup, ppm, quality, token_counts, toxicity, warc  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (4, "One."), (5, "é²\x1c日本 " * 3), (6, "word " * 3000)]


def frame(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"n_tokens": F.lit("clash"), "kept": F.lit("clash"), "score": F.lit("clash"), "hits": F.lit("clash")}) if extra else df


@pytest.fixture(scope="module")
def tk():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be <turn: good"), (2, 3, None, None), (2, 3, None, None), (None, 0, "assistant", "x\\")]
    rows += [(1, i, "user" if i % 2 else "assistant", f"{i} " * (i % 7 * 40) + ":> </turn>") for i in range(1, 60)] + [(3, None, "assistant", "long " * 2000), (3, 1, "a:", "\\" * 9)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("idx", F.lit("clash"))
    config = chat.ChatConfig(block_turns=16)
    windows = chat.format_windows(df, config).cache()
    got = {r["conv_id"]: r for r in chat.conversation_digests(windows).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        whole = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = windows.where("conv_id = 1").orderBy("window_start").collect()
    assert len(first) > 3 and all(w["formatted"].startswith("<turn:system:>") for w in first) and all(0 < w["n_repeated"] <= 3 for w in first[1:])
    assert chat.conversation_digests(chat.format_windows(df.limit(0))).count() == 0


def test_chat_budget(spark):
    random.seed(11)
    rows = [(c, 0, "system", "rules " * random.choice([3, 60, 900])) for c in range(12)]
    rows += [(c, i, "user" if i % 2 else "assistant", random.choice(["ok ", "日本語の文", "word " * 9]) * random.randrange(1, 60)) for c in range(12) for i in range(1, 50)]
    config = chat.ChatConfig()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_windows(df, config).collect()
    size = lambda t: max(len(t.split(" ")) - (not t.strip(" ") or t.endswith(" ")), -(-len(t.encode()) // 4)) + config.turn_overhead
    texts = {(c, i): size(t) for c, i, _, t in rows}
    starts = collections.defaultdict(list)
    for w in windows:
        starts[w["conv_id"]].append(w["window_start"])
    over = 0
    for w in windows:
        following = min((x for x in starts[w["conv_id"]] if x > w["window_start"]), default=50)
        own = [texts[w["conv_id"], i] for i in range(w["window_start"], following)]
        system = texts[w["conv_id"], 0] if w["window_start"] else 0
        history = w["n_repeated"] - (w["window_start"] > 0)
        total = sum(own) + system + sum(texts[w["conv_id"], w["window_start"] - 1 - k] for k in range(history) if w["window_start"] - 1 - k)
        assert total <= config.budget_tokens or history == 0
        assert sum(own) < config.span_tokens + config.long_tokens or len(own) == 1
        over += history > 0
    assert over > 10


def test_main_text(spark):
    page = (
        "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><header>Top</header><div class='cookie-notice'>We use</div><article><h1>A &amp; B</h1>"
        "<p>one  two<br>three <b>four</b><p class=ad>buy<p>five&#33;</p><!-- x --><script>var a='<p>';</script><section id=comments><p>nice</p></section></article><aside>side</aside><footer>f</footer>"
    )
    bare = "<div>Shared line</div><p>Own text {}</p><div>Shared end</div>"
    rows = [(1, "http://h/en/1", page), (2, "http://h/x/1", bare.format(1)), (3, "http://h/x/2", bare.format(2)), (4, None, None), (5, "", "a < b & c"), (6, "http://h/y", "<p>" + "<p>x</p>" * 5000)]
    got = {r["page_id"]: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("path", F.lit(1)), prefix=3).collect()}
    assert got[1]["text"] == "A & B\none two three four\nfive!" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "Own text 1" and got[3]["text"] == "Own text 2" and got[4]["text"] == "" and got[5]["text"] == "a < b & c" and got[6]["text"].count("x") == 5000


def test_main_text_beside_article():
    page = "<p>Shared</p><div>Own intro {0}</div><article><p>Passage of both</p><p>Own text {0}</p></article><p>Own note {0}</p><footer>Own foot {0}</footer><div>Shared end</div>"
    a, b = (html_extract.page_lines(page.format(i)) for i in (1, 2))
    assert html_extract.main_text(a, b) == ("Own intro 1\nPassage of both\nOwn text 1\nOwn note 1", 2)
    alone = ["Shared", "Own intro 1", "Passage of both", "Own text 1", "Own note 1", "Shared end"]
    assert [html_extract.main_text(a, x)[0].split("\n") for x in (None, a)] == [alone, alone]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_differencing_against_brute_force(spark):
    """Plain pairing and a plain LCS table over the driver's pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["page_id"], *re.fullmatch(r"(?:\w+://)?([^/?#]*)([^?#]*).*", r["url"] or "", re.DOTALL).groups(), html_extract.page_lines(r["html"] or "")) for r in pages.collect()]
    hosts = collections.defaultdict(list)
    for r in rows:
        hosts[r[1].lower()].append(r)
    want = {}
    for group in hosts.values():
        group.sort(key=lambda r: (r[2], r[0]))
        for i, (page_id, _, path, lines) in enumerate(group):
            near = [group[j] for j in (i - 1, i + 1) if 0 <= j < len(group)]
            best = max(near, key=lambda r: len(os.path.commonprefix([r[2], path])), default=None)
            a, b = [x[0] for x in lines], [x[0] for x in best[3]] if best else []
            size = np.zeros((len(a) + 1, len(b) + 1), int)
            for x, y in itertools.product(range(len(a)), range(len(b))):
                size[x + 1, y + 1] = size[x, y] + 1 if a[x] == b[y] else max(size[x, y + 1], size[x + 1, y])
            want[page_id] = (size[-1, -1], sum(not boiler for _, boiler, _ in lines))
    got = html_extract.extract_main_text(pages).collect()
    assert len(got) == len(rows) and sum(r["n_shared"] > 0 for r in got) > 5  # most of these pages share no line beside the article with their neighbour
    assert all(r["n_shared"] <= want[r["page_id"]][0] for r in got)
    beside = {r[0]: sum(not c for _, _, c in r[3]) for r in rows}
    assert all(r["n_shared"] <= beside[r["page_id"]] and len(r["text"].splitlines()) <= want[r["page_id"]][1] for r in got)


def test_main_text_pairs_within_host(spark):
    random.seed(2)
    page = "<div>Menu of {h}</div><p>Own text {i}</p><div>Foot of {h}</div>"
    urls = ["http://a/x/1", "http://a/y/2", "https://b/1", "http://B/other/path/2?q", "http://alone/1", *(f"http://big/{random.choice('pqrs')}{random.randint(0, 10**6)}/{i}.html" for i in range(60)), None, ""]
    rows = [(None if i == 7 else i, u, page.format(h=u.split("/")[2].lower() if u else "", i=i)) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")

    hosts = [u.split("/")[2].lower() if u else "" for u in urls]
    # Every page with another page on its host loses menu and foot, whichever page it is paired with.
    want = sorted((str(r[0]), f"Own text {i}" if hosts.count(h) > 1 else f"Menu of {h}\nOwn text {i}\nFoot of {h}") for i, (r, h) in enumerate(zip(rows, hosts)))
    for parts in (None, 1, 7, 500):
        got = sorted((str(r["page_id"]), r["text"]) for r in (html_extract.extract_main_text(df, parts=parts) if parts else html_extract.extract_main_text(df)).collect())
        assert got == want
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_common_lines():
    random.seed(1)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html_extract.common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(x == y for y in rest) for x in (a[i] for i in found))


def test_warc(spark):
    rows = [(1, "http://a", "same"), (5, "http://b\r\nc", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (6, "u", "é\r\n\r\nx"), (None, "u", "same"), (None, "v", "alone")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha256", F.lit("clash"))
    archive = warc.write_archive(df)
    assert archive.payloads.count() == 4
    got = warc.parse_records(warc.read_records(archive)).collect()
    want = []
    for i, _, page in rows:
        body = (page or "").encode()
        owner = max((r[0] for r in rows if (r[2] or "") == (page or "") and r[0] is not None), default=None)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == owner else "revisit", None if i == owner else owner))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert {r["page_id"]: bytes(r["payload"]) for r in warc.full_payloads(archive).collect()}[1] == b"same"
    assert all(r["record_type"] == "response" for r in warc.parse_records(warc.read_records(warc.write_archive(df, min_bytes=100))).collect())
    assert warc.read_records(warc.write_archive(df.limit(0))).count() == 0
    assert {(r["page_id"], r["url"]) for r in warc.parse_records(warc.read_records(archive)).collect()} == {r[:2] for r in rows}


def test_warc_records_are_warc(spark):
    """A parser of WARC/1.1 by the letter reads the concatenated records; long payloads and repeated ids stay whole."""
    rows = [(1, "http://a/x?y=1", "p" * 300_000 + "\r\n\r\nWARC/1.1\r\n"), (2, "http://a/ü", "same é"), (3, "http://a/3", "same é"), (3, "http://a/3", "same é"), (3, "http://a/3", "other"), (4, None, None)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), date="2020-02-03T04:05:06Z")
    data = b"".join(bytes(r["record"]) for r in warc.read_records(archive).collect())
    seen = []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        block, data = rest[:size], rest[size:]
        assert version == "WARC/1.1" and len(fields) == len(lines) and data.startswith(b"\r\n\r\n")
        data = data[4:]
        assert re.fullmatch(r"<urn:page:\d+>", fields["WARC-Record-ID"]) and fields["WARC-Date"] == "2020-02-03T04:05:06Z" and fields["Content-Type"] == "application/http; msgtype=response"
        http, payload = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 ")
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and fields["WARC-Profile"].startswith("http://netpreserve.org/warc/1.1/revisit/") and fields["WARC-Refers-To"] == "<urn:page:3>"
        else:
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            seen.append((int(fields["WARC-Record-ID"][10:-1]), fields.get("WARC-Target-URI"), payload.decode()))
    assert sorted(map(str, seen)) == sorted(map(str, [(1, *rows[0][1:]), (3, "http://a/3", "same é"), (3, "http://a/3", "same é"), (3, "http://a/3", "other"), (4, None, "")]))


def test_quality(spark):
    rows = ODD + [(7, "a b c d e f a b c d e x y z a b c d e"), (8, "Home | About | Login\n" + "A clean line of plain words stands here.\n" * 1 + "Another plain line ends the text here."), (9, "BUY!! NOW!! CHEAP!! PILLS!! TODAY!! HERE!! FAST!! GOOD!! NEW!! BEST!!"), (10, "x*** y### z$$$ a%%% b&&& c*** d### e$$$ f%%% g&&&")]
    got = {r["doc_id"]: r for r in quality.apply_quality_rules(frame(spark, rows)).where("doc_id IS NOT NULL").collect()}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {p for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
    assert got[8]["kept"] and "Home" not in got[8]["cleaned_text"] and not got[9]["kept"] and not got[10]["kept"] and not got[1]["kept"]
    assert quality.apply_quality_rules(frame(spark)).where("kept").count() == 0 and quality.apply_quality_rules(frame(spark).limit(0)).count() == 0


def near_components(rows, size):
    """Brute force: rows of (doc_id, text) as (doc_id, text, n_shingles, component_id), every row a document of its own."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in rows]
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if None not in (rows[i][0], rows[j][0]) and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d) if d is not None else None
    return collections.Counter((d, t, len(sets[i]), least[top(i)]) for i, (d, t) in enumerate(rows))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_near_duplicates(spark, parts):
    random.seed(5)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    # Copies edited to either side of the threshold, so that some meet no link with the least edited one.
    for start, n, edits in ((0, 60, (0, 1, 2, 3, 4)), (1000, 90, (0, 2, 4, 5, 6, 7))):
        base = [random.choice(words) for _ in range(60)]
        for i in range(n):
            w = list(base)
            for _ in range(random.choice(edits)):
                w[random.randrange(60)] = random.choice(words[:40])
            rows.append((start + i, " ".join(w)))
    rows += [(200 + i, t) for i, t in enumerate(["", None, "a", "A", "a b", "a  B\n", "a b c", "b a", "same same same", "same same"])]
    long = " ".join(random.choice(words) for _ in range(20000))
    rows += [(300, long), (301, long.replace(" w7 ", " x ")), (302, long + " end"), (None, long), (None, None)]
    one, two = (" ".join(random.choice(words) for _ in range(50)) for _ in range(2))
    rows += [(401, one), (402, two), (405, one + " more"), (405, two + " more"), (405, two + " more"), (406, two + " more"), (1010, one)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_shingles", F.lit("clash")).repartition(parts)
    marks = {r["mark"]: r["text"] for r in df.select("text", F.xxhash64("text").alias("mark")).collect()}
    got = neardup.near_duplicates(df, neardup.SketchConfig(shingle=2)).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert collections.Counter((r["doc_id"], marks[r["mark"]], r["n_shingles"], r["component_id"]) for r in got) == near_components(rows, 2)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(frame(spark).limit(0)).count() == 0
    assert {r["component_id"] for r in neardup.near_duplicates(frame(spark, [(1, None), (2, " ")])).collect()} == {1, 2}


def test_prefixes_find_every_link(spark):
    """Members of one group: the join of prefixes finds each link between components, and far fewer pairs than there are."""
    rng = np.random.default_rng(3)
    head = rng.choice(1 << 62, 120, replace=False).astype(np.uint64)
    pool = rng.choice(1 << 62, 400, replace=False).astype(np.uint64)
    sets = [np.unique(head)]
    for i in range(150):
        k = int(rng.integers(1, 22))
        base = head if i < 100 else sets[int(rng.integers(1, 100))]  # the last third are copies of copies
        sets.append(np.unique(np.concatenate([rng.choice(base, len(base) - k, replace=False), rng.choice(pool, k, replace=False)])))
    linked = lambda a, b: neardup._is_link(len(np.intersect1d(a, b)), len(a), len(b), config)
    config = neardup.SketchConfig()
    found = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node bigint, shingles binary")
    label = [0 if linked(sets[0], s) else i for i, s in enumerate(sets)]
    members = spark.createDataFrame([(0, i, label[i], 0) for i in range(1, len(sets))], "head bigint, node bigint, component bigint, first bigint")
    met = {(r["a"], r["b"]) for r in neardup._meetings(members, found, config).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(1, len(sets)), 2) if label[i] != label[j] and linked(sets[i], sets[j])}
    assert len(want) > 5 and want <= met and len(met) < 3000


def test_components_by_blocks(spark, monkeypatch):
    """One block of links is contracted without rounds; many blocks, of a long chain too, give the same."""
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (220, 2))] + [(7, 7), (5, 4), (5, 4), (2000, 2000), (1 << 60, 3000)]
    roots = {}
    find = lambda x: x if roots.setdefault(x, x) == x else find(roots[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        roots[b] = a
    want = sorted((x, find(x)) for x in {x for a, b in pairs if a != b for x in (a, b)})
    links = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7).cache()
    written = []
    monkeypatch.setattr(neardup, "materialize", lambda df, name, real=neardup.materialize: written.append(name) or real(df, name))
    assert sorted(map(tuple, neardup.components(links).collect())) == want and len(written) == 1
    assert sorted(map(tuple, neardup.components(links, block=100).collect())) == want and len(written) > 3
    assert neardup.components(links.limit(0)).count() == 0


def test_near_duplicates_in_few_tasks(spark):
    """Many shuffle partitions make few Python tasks, and components no tasks for each partition and round."""
    random.seed(6)
    base = [f"w{random.randrange(900)}" for _ in range(60)]
    rows = [(i, " ".join(base[: i % 25] + [f"x{i % 5}"] + base[i % 25 + i % 7 :])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    spark.sparkContext.setJobGroup("few", "")
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = neardup.near_duplicates(df, neardup.SketchConfig(shingle=2)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, _, _, c in near_components(rows, 2)}
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("few") for s in status.getJobInfo(j).stageIds]
    ran = sum(s.numCompletedTasks for s in stages if s)
    assert ran < 1500


def test_setsketch_estimates():
    config = neardup.SketchConfig()
    rng = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8, 0.95):
        n = 2000
        shared = round(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        k = neardup.sketches([pool[:n], pool[n - shared :]], config)
        assert abs(neardup.estimate(k[0], k[1], n, n, config) - j) < 5 * math.sqrt(j * (1 - j) / config.registers) + 0.01
        assert (np.maximum(k[0], k[1]) == neardup.sketches([pool], config)[0]).all()  # mergeable


def test_bpe(spark, tk):
    rows = ODD + [(8, "a" * 5000 + "ab" * 4000), (9, "it's we'll  \n\n x_y <|endoftext|> 12³Ⅷ")]
    random.seed(2)
    rows += [(20 + i, "".join(random.choice(["a", "the", " ", "\n", "'s", "1", "é", "日", "²", "\x1f", "zq"]) for _ in range(30))) for i in range(100)]
    coded = bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN)
    texts = dict(rows)
    for r in bpe.decode(coded, RANKS).collect():
        text = texts[r["doc_id"]] or ""
        ids = tk.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(frame(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts(spark, tk):
    random.seed(3)
    pieces = ["a", "the", " ", "  ", "\n", "'s", "'", "r", "e", "1", "é", "word and more ", "日", "²"]
    text = lambda n: "".join(random.choice(pieces) for _ in range(n))
    rows, edits = [*ODD], {}
    rows += [(50 + i, text(random.choice([0, 5, 300]))) for i in range(60)]
    table = [(i, t, [{"start": random.randint(-2, 900), "length": random.choice([0, 1, 9, 400]), "insert": text(random.choice([0, 2, 500]))} for _ in range(3)] if k % 9 else None) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(table, f"doc_id bigint, text string, edits {token_counts.EDITS}").withColumn("tree", F.lit("clash"))
    got = token_counts.apply_edits(token_counts.count_tokens(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    want = collections.Counter()
    for _, t, changes in table:
        t = t or ""
        for e in changes or ():
            start = min(max(e["start"], 0), len(t))
            t = t[:start] + e["insert"] + t[min(start + e["length"], len(t)) :]
        want[t, len(tk.encode_ordinary(t))] += 1
    assert collections.Counter((r["text"], r["n_tokens"]) for r in got) == want and not edits


def test_edits_encode_only_their_surroundings(tk):
    random.seed(8)
    some = ["alpha ", "beta, ", "x9 ", "\n\n", "it's ", "gamma ", "日本 "]
    bpe_ = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    text = "".join(random.choice(some) for _ in range(20000))
    state = token_counts.CountedText(bpe_, text)
    for words in (0, 1, 30, 180, 3000, 180, 0):
        start, length, insert = random.randrange(len(state.text)), random.choice([0, 5, 300]), "".join(random.choice(some) for _ in range(words))
        touched = len(tk.encode_ordinary(state.text[start : start + length])) if length else 0
        before = state.encoded
        state.edit(start, length, insert)
        assert state.encoded - before <= len(bpe_.findall(insert)) + touched + 4 * token_counts.LEAF
        assert state.n_tokens == len(tk.encode_ordinary(state.text)) and state.tree[1, 0] == len(state.text)
    bpe_.release()
    assert not bpe_.older and bpe_.packed(["alpha beta"])[0] == np.array(tk.encode_ordinary("alpha beta"), "<u4").tobytes()


def test_cache_is_bounded(monkeypatch, tk):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    bpe_ = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    for i in range(60):
        texts = [" ".join(f"word{random.randrange(i, i + 40)}" for _ in range(30)) for _ in range(2)]
        assert [np.frombuffer(p, "<u4").tolist() for p in bpe_.packed(texts)] == [tk.encode_ordinary(t) for t in texts]
        assert len(bpe_.cache) + len(bpe_.older) < 250


def test_counts_of_nothing(spark):
    counted = token_counts.count_tokens(frame(spark).limit(0).withColumn("edits", F.lit(None).cast(token_counts.EDITS)), RANKS, public_tokenizers.PATTERN)
    assert token_counts.apply_edits(counted, RANKS, public_tokenizers.PATTERN).count() == 0


def test_toxicity(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        rows.append((i, " ".join(random.choice(words) for _ in range(40)) + (" nasty vile" if bad else "")))
        labels.append((i, int(bad)))
    df, marks = spark.createDataFrame(rows + ODD, "doc_id bigint, text string"), spark.createDataFrame(labels + [(None, 1)], "doc_id bigint, toxic int")
    outside = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(df, marks, eligible=~outside)
    got = {r["doc_id"]: r for r in toxicity.score(df.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95 and 0 < len(model.coordinates) < 5000
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000 if 1000 in got else 1]["score"] is not None
    empty = toxicity.fit(df, marks.limit(0))
    assert all(r["score"] == 0.5 for r in toxicity.score(df, empty).collect())


def test_ppm(spark):
    rows = [(i, f"The cat {i % 7} sat on Mat {i}\nand {'the ' * (i % 4)}end é") for i in range(60)] + ODD + [(None, "no id")]
    got = ppm.score_documents(frame(spark, rows), ppm.PpmConfig(head=5)).collect()
    low = lambda t: (t or "").translate(LOWER).encode()
    learn = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter()
    trie = collections.defaultdict(collections.Counter)
    for t in learn:
        counts.update([*low(t).split(), b""])
        s = b"\xfe" * 3 + low(t) + b"\xff"
        for p in range(3, len(s)):
            for k in range(4):
                trie[s[p - k : p]][s[p]] += 1
    total, kinds = sum(counts.values()), len(counts)

    def code(context, symbol):
        gone, out = {0xFE}, 0.0
        for k in range(3, -1, -1):
            seen = {x: n for x, n in trie.get(context[3 - k :], {}).items() if x not in gone}
            if seen:
                t, d = sum(seen.values()), len(seen)
                if symbol in seen:
                    return out + math.log10(seen[symbol] / (t + d))
                out += math.log10(d / (t + d))
                gone |= set(seen)
        return out - math.log10(256 - len(gone))

    want = []
    for i, t in rows:
        own = [*low(t).split(), b""]
        s = b"\xfe" * 3 + low(t) + b"\xff"
        want.append((i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(w in counts for w in own), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own), 5), round(sum(code(s[p - 3 : p], s[p]) for p in range(3, len(s))), 1)))
    have = [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 1)) for r in got]
    for a, b in zip(sorted(have), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=0.2)
    assert len(have) == len(want) and ppm.score_documents(frame(spark).limit(0)).count() == 0


def test_ppm_uses_all_grams(spark):
    random.seed(3)
    rows = [(i, "".join(random.choice("abcdeé 日") for _ in range(random.randint(0, 60)))) for i in range(80)] + ODD + [(None, "no id"), (1002, "zzQ unseen \U0001f600")]
    df = frame(spark, rows)
    for order in (0, 1, 3, 5):
        want, got = (
            sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in ppm.score_documents(df, ppm.PpmConfig(order=order, max_grams=cap)).collect()) for cap in (1 << 20, 5)
        )
        for a, b in zip(want, got, strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-6)
    # Order 5, against brute force.
    trie = collections.defaultdict(collections.Counter)
    mark = lambda t: b"\xfe" * 5 + (t or "").translate(LOWER).encode() + b"\xff"
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            for p in range(5, len(s := mark(t))):
                for k in range(6):
                    trie[s[p - k : p]][s[p]] += 1

    def code(context, symbol):
        gone, out = {0xFE}, 0.0
        for k in range(5, -1, -1):
            if seen := {x: n for x, n in trie[context[5 - k :]].items() if x not in gone}:
                whole = sum(seen.values()) + len(seen)
                if symbol in seen:
                    return out + math.log10(seen[symbol] / whole)
                out += math.log10(len(seen) / whole)
                gone |= set(seen)
        return out - math.log10(256 - len(gone))

    brute = sorted((str(i), sum(code(s[p - 5 : p], s[p]) for p in range(5, len(s)))) for i, t in rows for s in [mark(t)])
    have = sorted((a[0], a[4]) for a in got)
    for (i, x), (j, y) in zip(brute, have, strict=True):
        assert i == j and x == pytest.approx(y, rel=1e-6)


def test_decontamination(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice([0, 3, 12, 25])))) for i in range(20)] + [(20, None), (None, "solo words here"), (3, "w1 w2")]
    docs = []
    for i in range(80):
        w = [random.choice(words) for _ in range(60)]
        if i % 3 == 0:
            x = (items[i % 23][1] or "").split()
            w[20:20] = x[: random.choice([9, 10, 11, 30])]
        docs.append((1000 + i, "-".join(w).upper() if i % 2 else ", ".join(w)))
    df = frame(spark, docs + ODD)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(None if i is None else str(i))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1_000_000, 20):
        got = decontam.decontaminate(df, bench, decontam.DecontamConfig(block_words=block)).collect()
        assert len(got) == len(docs) + len(ODD)
        for r in got:
            w, hit, found = split(dict(docs + ODD)[r["doc_id"]]), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])]
            ids = ",".join(sorted(x for x in found if x is not None))
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontam.decontaminate(df, bench.limit(0)).collect()} == {0}


def test_proximity_matches(spark):
    random.seed(7)
    words = [f"w{i}" for i in range(9)]
    docs = [(i, " ".join(random.choice(words + ["x"] * 6) for _ in range(40))) for i in range(60)] + [(60, None), (61, "a b0 q q q q q c b1 b1 a")]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice([2, 4, 12])))) for i in range(25)] + [(40, "w1 w1 w2"), (41, None)]
    slop = 2
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1_000_000, 15):
        got = {(r["doc_id"], r["item_id"], r["position"]) for r in decontam.find_near_matches(index, bench, slop, decontam.DecontamConfig(block_words=block)).collect()}
        rows = [(d, (t or "").split()) for d, t in docs]
        total = collections.Counter(w for _, ws in rows for w in ws)  # one shard: a term's rarity is that of all documents
        want = set()
        for i, t in items:
            ws = (t or "").split()
            n = min(10, len(ws))
            for k in range(len(ws) - n + 1) if n else ():
                window, need = ws[k : k + n], collections.Counter(ws[k : k + n])
                rare = min(total[w] for w in window)
                for d, x in rows:
                    for start in range(1 - n - slop, len(x)):
                        part = x[max(start, 0) : max(start + n + slop, 0)]
                        if not need - collections.Counter(part):
                            want |= {(d, str(i), max(start, 0) + j, w) for j, w in enumerate(part) if w in need and total[w] == rare}
        assert got and got <= {x[:3] for x in want}
        assert {x[:2] for x in got} == {x[:2] for x in want}


def test_leaves_by_joins_are_those_of_single_pre_tokens():
    import public_tokenizers

    from lattica.llm import token_counts as C
    from lattica.llm.bpe import Encoder, load_ranks

    bpe = Encoder(load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    for text in ("", "one", "a b " * 16, "x y " * 17, "héllo wörld 语言 ١٢٣ \n\n\t end " * 40, "\ud800 odd"):
        pieces = bpe.pieces([text])[0]
        want = C.leaves_of(np.array([len(p) for p in pieces], np.int64), np.array(bpe.counts(pieces), np.int64))
        got = C.leaves_by_joins(bpe, pieces)
        assert got.shape == want.shape and (got == want).all() and (C.tree_over(got) == C.tree_over(want)).all()


def test_new_pre_tokens_are_merged_in_few_steps(monkeypatch, tk):
    """Finding op8: a block's new pre-tokens take a step for each length and its merge, not for each rank that they merge by."""
    random.seed(21)
    bpe_ = token_counts.RowEncoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    steps, lookup = [], bpe_._rank_of_pairs
    monkeypatch.setattr(bpe_, "_rank_of_pairs", lambda *pairs: steps.append(1) or lookup(*pairs))
    words = ["".join(random.choice(["a", "b", "st", "e", "qu", "ing", "é", "日本"]) for _ in range(random.randrange(1, 12))) for _ in range(20000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    assert [np.frombuffer(p, "<u4").tolist() for p in bpe_.packed(texts)] == [tk.encode_ordinary(t) for t in texts]
    assert len(steps) <= 3 * token_counts.SWEEP_PIECE
    odd = ["", "a", "z" * 63, "z" * 64, "z" * 65, "xy" * 1000 + "q", "ab" * 3000, "日" * 30, "\x00\x01\x00", "�" * 21, "aaaa", "aaaaaaa"]
    assert bpe_.merge_many([p.encode() for p in odd]) == bpe.Encoder.merge_many(bpe_, [p.encode() for p in odd])
    assert [np.frombuffer(p, "<u4").tolist() for p in bpe_.packed(odd)] == [tk.encode_ordinary(t) for t in odd] and bpe_.merge_many([]) == []


def test_counts_and_edits_in_one_pass(spark):
    """Finding op8: one Python pass with one cache, the same rows as of two operators."""
    from lattica.llm import registry

    plan = registry.op8_token_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    random.seed(22)
    text = lambda n: "".join(random.choice(["a", "the", " ", "\n", "'s", "é", "word ", "日", "²", "12"]) for _ in range(n))
    rows = [*ODD, (None, "no id"), (9, "gone"), *((20 + i, text(random.choice([1, 40, 400]))) for i in range(40))]
    change = lambda: {"start": random.randint(-2, 900), "length": random.choice([0, 1, 9, 400, None]), "insert": random.choice([None, text(random.choice([0, 2, 500]))])}
    table = [(i, t, None if k % 9 == 0 else [{"start": 0, "length": 9, "insert": ""}] * 2 if t == "gone" else [change() for _ in range(k % 4)]) for k, (i, t) in enumerate(rows)]
    table.append((8, "one two", [None, {"start": 3, "length": 0, "insert": " and"}, None, {"start": 0, "length": 3, "insert": "three"}]))
    df = spark.createDataFrame(table, f"doc_id bigint, text string, edits {token_counts.EDITS}").withColumns({c: F.lit("clash") for c in ("tree", "n_before", "n_encoded")})
    args = RANKS, public_tokenizers.PATTERN
    names = ["doc_id", "n_before", "text", "tree", "n_tokens", "n_encoded"]
    two = token_counts.apply_edits(token_counts.count_tokens(df, *args).withColumn("n_before", F.col("n_tokens")), *args)
    count = lambda out: collections.Counter(map(str, out.collect()))
    assert count(token_counts.count_edits(df, *args).select(names)) == count(two.select(names))
    assert two.where("doc_id = 8").first()["text"] == "three and two"
    short = token_counts.count_edits(df, *args, keep_state=False)
    assert not {"text", "tree"} & set(short.columns) and count(short.select("doc_id", "n_before", "n_tokens", "n_encoded")) == count(two.select("doc_id", "n_before", "n_tokens", "n_encoded"))
    assert token_counts.count_edits(df.limit(0), *args).count() == 0
