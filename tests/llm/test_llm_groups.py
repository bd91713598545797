"""Spelling groups, web archives and the conversation trie against brute force on small odd tables."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("fluoroframe.llm")

from fluoroframe.llm import chat_trie, spelling, warc  # noqa: E402
from fluoroframe.plans.cut import shared_folder  # noqa: E402

# Spelling variants


def apart(a, b):
    """Exactly one letter put in, left out or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def word_list(seed, letters, lengths, count):
    rng = random.Random(seed)
    made = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(count)}
    for w in list(made)[: count // 2]:
        at = rng.randrange(len(w))
        made.add(rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :])))
    return sorted(w for w in made if w)


@pytest.mark.parametrize("letters, lengths", [("ab", (1, 12)), ("abc", (7, 11)), ("abcdefghijklmnopqrst", (7, 9)), ("aé×ÿ", (5, 9))])
def test_words_one_apart_share_a_key(letters, lengths):
    words = word_list(1, letters, lengths, 400)
    counts = Counter(w[p : p + q] for w in words for q in range(2, spelling.LONGEST) for p in range(len(w) - q + 1))
    for above in (3, 40, 10**9):
        grams = spelling.Grams({g: c for g, c in counts.items() if c > above}, above)
        keys = {w: set(grams.keys(w)) for w in words}
        for i, a in enumerate(words):
            for b in words[:i]:
                if apart(a, b):
                    assert keys[a] & keys[b], (a, b, above)


def test_bound_holds_for_every_edit():
    rng = random.Random(2)
    words = word_list(3, "abcd", (2, 10), 200)
    counts = Counter(w[p : p + q] for w in words for q in range(2, spelling.LONGEST) for p in range(len(w) - q + 1))
    grams = spelling.Grams({g: c for g, c in counts.items() if c > 8}, 8)
    for w in words:
        mine = grams.places(w)
        bound = grams.bound(w, mine)
        for _ in range(30):
            at, x = rng.randrange(len(w)), rng.choice("abcde")
            for other, moved in ((w[:at] + w[at + 1 :], -1), (w[:at] + x + w[at:], 1), (w[:at] + x + w[at + 1 :], 0)):
                left = set(grams.places(other))
                kept = sum(((p, e) in left and e <= at) or ((p + moved, e + moved) in left and p >= at + (moved < 1)) for p, e in mine)
                assert len(mine) - kept <= bound


def brute_groups(docs, one_in=31):
    count = Counter()
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 7
    words = {w: n for w, n in count.items() if n >= 2}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_spelling_groups_against_brute_force(spark):
    rng = random.Random(4)
    base = word_list(5, "abé", (6, 9), 60)
    docs = [(i, " ".join(rng.choice(base) for _ in range(20))) for i in range(30)]
    docs += [(100 + i, "Chaining chainingg, ") for i in range(2)] + [(200 + i, "chaining " * 20) for i in range(20)] + [(300, "chaininggs chaininggs"), (301, "chainingg " * 18)]
    docs += [(None, "nobody Nobody nobody"), (1, None), (2, ""), (3, "x" * 5000 + " " + "x" * 4999), (4, "x" * 5000 + " " + "x" * 4999), (5, "équation ÉQUATION équation, Ãquation")]
    docs += docs[:3]
    table = spark.createDataFrame([(d, t, 9, "w") for d, t in docs], "doc_id long, text string, n int, word string")
    got = {tuple(r) for r in spelling.spelling_groups(table).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_groups(docs)
    assert any(w == "chainingg" and f == "chaining" for w, f, *_ in got)
    assert spelling.spelling_groups(table.limit(0)).count() == 0


# Web archives

GAP = b"\r\n\r\n"


def test_parse_follows_lengths_through_every_cut():
    rng = random.Random(6)
    blocks = [b"", b"\r\n", GAP, GAP * 3, b"\r\r\n\r\n", b"a\r\n\r", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc" + GAP, b"x" * 10_000]
    blocks += [bytes(rng.choice(b"\r\na") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    stream = b"".join(b"WARC/1.1\r\nN: %d\r\nContent-Length: %d" % (i, len(b)) + GAP + b + GAP for i, b in enumerate(blocks))
    rows = stream.split(GAP)
    assert [(int(h["N"]), b) for h, b in warc.parse(iter(rows))] == list(enumerate(blocks))
    assert list(warc.parse(iter([]))) == [] and list(warc.parse(iter([b"", b"\r\n"]))) == []
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"WARC/1.1\r\nContent-Length: 900", b"short"])))


def test_archives_keep_equal_payloads_once(spark):
    big, other = "<p>é</p>\r\n\r\n" * 30, "b" * 100
    rows = [(7, "http://a/7", big), (3, "http://a/3 x\r\nWARC-Type: no", big), (9, None, big), (5, "", other), (4, "http://ü/", other + "c"), (6, "u", other)]
    rows += [(8, "u", "short"), (2, "u", "short"), (1, "u", None), (10, "u", ""), (None, "u", big), (None, "v", "n" * 200), (None, "w", "n" * 200), (3, "http://a/3 x\r\nWARC-Type: no", big)]
    rows += [(20, "long", "y\r\n\r\n" * 200_000 + "\r\n"), (21, "long", "\r\n" * 3)] + [(1000 + i, f"u{i}", big) for i in range(50)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload_digest string, record_type int").repartition(5)
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    warc.write_archives(pages, f"{folder}/a")
    whole = warc.read_archives(spark, f"{folder}/a", with_payload=True)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert sorted(((r.page_id, r.url, r.payload) for r in whole.collect()), key=key) == sorted(((p, u, h or "") for p, u, h in rows), key=key)
    warc.write_once(pages, f"{folder}/b")
    once = warc.read_archives(spark, f"{folder}/b", with_payload=True)
    kept = defaultdict(list)
    for r in once.collect():
        if r.record_type == "response":
            kept[r.payload_digest].append(r.payload)
            assert hashlib.sha256(r.payload.encode()).hexdigest() == r.payload_digest and len(r.payload.encode()) == r.payload_bytes
        else:
            assert r.payload is None and r.refers_to_record
    assert all(len(v) == 1 for v in kept.values() if len(v[0].encode()) >= 100)
    first = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", p)
    want, seen = [], set()
    for p, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        h = h or ""
        again = len(h.encode()) >= 100 and h in seen
        seen.add(h)
        want.append((p, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(once).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    merged = whole.unionByName(once.where("record_type = 'response'")).withColumnRenamed("payload", "html")  # two archives as one table
    warc.write_once(merged, f"{folder}/c", date_column="date")
    again = warc.resolve(warc.read_archives(spark, f"{folder}/c")).collect()
    assert len(again) == len(rows) + once.where("record_type = 'response'").count()
    large = [r for r in again if r.payload_bytes >= 100]
    assert sum(r.record_type == "response" for r in large) == len({r.payload_digest for r in large})


def test_archives_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    warc.write_archives(pages, f"{folder}/a")
    warc.write_once(pages, f"{folder}/b")
    assert warc.resolve(warc.read_archives(spark, f"{folder}/b")).count() == 0


# Conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), digest(role, text), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(who) - 1) * words
    out = []
    for n, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if built[c] == n))
        up = min(members[n[:-1]]) if n else None
        out.append((min(who), len(n), up, len(who), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(seed, convs, texts, most):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(("user", "bot")), rng.choice(texts)) for c in rng.sample(range(convs * 2), convs) for t in range(rng.randint(1, most))]
    same = [(3000 + c, t, "user", f"same {t}") for c in range(60) for t in range(6)]  # copies of one conversation
    odd = [(5000, None, None, None), (5000, 2, "user", "b  c"), (5000, 2, "user", "b  c"), (5000, 2, "bot", "a"), (None, 1, "user", "x"), (1 << 60, 0, "user", "far")]
    deep = [(7000 + c, t, "user", "deep") for c in range(12) for t in range(300)] + [(7100, t, "user", "deep") for t in range(290)]
    rows += same + odd + deep
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_against_brute_force(spark, monkeypatch, shards):
    monkeypatch.setattr(chat_trie, "ENDS_BYTES", 40)
    rows = trie_rows(shards, 120, ["a b", "c", "", "d e f"], 6)
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    got = chat_trie.prefix_trie(table, shards)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_skeleton_names_shared_beginnings_once():
    path = lambda s: b"".join(c.encode().ljust(16) for c in s)
    skeleton = chat_trie.Skeleton([(path("ab"), 1), (path("abc"), 5), (path("abc"), 9), (path("ad"), 2), (path("b"), 0)])
    assert skeleton.first == [[0, 0, 0], [0, 0, 0, 1], [0, 0, 0, 1], [0, 0, 3], [0, 4]]
    assert skeleton.way(path("abcz"), skeleton.shard(path("abcz"), 0)) == [0, 0, 0, 1]
    assert skeleton.way(path("q"), skeleton.shard(path("q"), 0)) == [0]


def test_trie_of_no_conversation(spark):
    assert chat_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# Exact top-k search with large components


def test_large_components_take_part(spark):
    from fluoroframe.llm import topk

    rng = random.Random(9)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(3)] for i in range(40)}
    vectors[7], vectors[8], vectors[9] = [1e8, 0.5, 0.0], [-3e10, 1.0, 1.0], [2.0**44, 0.0, -1.0]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()] + [(90, [float("inf"), 0.0, 0.0], 1), (91, [1.0, None, 0.0], 1)], "vec_id long, embedding array<double>, score int")
    import math as m

    whole = {i: [m.floor(256 * x) for x in v] for i, v in vectors.items()}
    small = [i for i in whole if i not in (7, 8, 9)]
    got = {}
    for r in topk.top_k(table, table.where(table.vec_id.isin(small)), 4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in small:
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q))[:4]
        assert got[q] == [(i, -s) for s, i in scores]
    with pytest.raises(Exception, match="too large"):
        topk.top_k(table, table.where("vec_id = 9"), 4).collect()
