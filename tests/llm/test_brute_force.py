"""Operators against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import html
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import common as K
from barloom.llm import components as C
from barloom.llm import minhash_dedup as M
from barloom.llm.chat_format import conversation_digests, format_conversations
from barloom.llm.common import word_count, written
from barloom.llm.components import components
from barloom.llm.exact_dedup import exact_dedup
from barloom.llm.html_extract import main_text
from barloom.llm.license_scan import TEMPLATES, scan_licenses
from barloom.llm.packing import Rounds, pack_documents
from barloom.llm.queries import URL_RULES, tokenizer_file
from barloom.llm.source_mix import mix_sources
from barloom.llm.topk_search import topk_search
from barloom.llm.toxicity import toxicity_scores
from barloom.llm.url_templates import judge_urls


def near_copies(rng, n_groups=12, size=14, words=60):
    """Groups of edits of a text; edits of edits too, so that links form chains."""
    texts = []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(10_000)}" for _ in range(words)]
        family = [base]
        for _ in range(size - 1):
            t = list(rng.choice(family))
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10_000)}"
            family.append(t)
        texts += [" ".join(t) for t in family]
    texts += [texts[0], texts[5], texts[5].upper()]
    return texts


def linked_components(texts, k, percent):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("bucket_block", "text_block"), [(2048, 512), (5, 4)])
def test_minhash_components(spark, bucket_block, text_block, monkeypatch):
    texts = near_copies(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = M.minhash_dedup(docs, shingle_words=4, percent=80, bucket_block=bucket_block, text_block=text_block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made.collect()}
    assert [got[i] for i in range(len(texts))] == linked_components(texts, 4, 80)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(5)
    a, b = M._coefficients(150)
    for share in (0.7, 0.8, 0.9):
        got = []
        for _ in range(40):
            common, rest = int(400 * share), 400 - int(400 * share)
            x = rng.integers(0, 2**63, 400 + rest, np.uint64)
            left, right = x[:400], np.concatenate([x[:common], x[400:]])
            s = [M.odd_sketch(M.minhash(v, a, b), 512) for v in (left, right)]
            bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
            got.append(M.odd_estimate(bits, 150, 512))
        assert abs(np.mean(got) - common / (400 + rest)) < 0.05
    assert M.bit_limit(0.8, 150, 512) < 150


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7)]
    made = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        assert made.get(start, start) == min(seen)


@pytest.mark.parametrize("shuffled", [False, True])
def test_components_of_a_chain(spark, monkeypatch, shuffled):
    """A chain of 1,000 nodes takes a number of steps that grows with its logarithm."""
    steps = []

    def counted(df, name):
        steps.append(name)
        return written(df, name)

    monkeypatch.setattr(C, "written", counted)
    nodes = list(range(1000))
    if shuffled:
        random.Random(3).shuffle(nodes)
    made = C.components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long"))
    assert {(r["node"], r["root"]) for r in made.collect()} == {(i, 0) for i in range(1000)}
    assert steps.count("roots") <= 8 and steps.count("hangs") <= 24


def test_torn_blocks_of_a_large_component(spark):
    """Strays meet a large component once per block of strays; all pairs across components share a key, none within the largest."""
    members = [(1, i, 0) for i in range(60)] + [(1, 100 + i, 100 + i // 3) for i in range(9)] + [(2, 200 + i, 200 + i) for i in range(5)]
    rows = M._torn_blocks(spark.createDataFrame(members, "cluster long, node long, root long"), 4).collect()
    met, at = set(), {}
    for r in rows:
        at.setdefault(r["key"], []).append(r)
    for same in at.values():
        left, right = ([r for r in same if r["side"] == s] for s in (0, 1))
        met |= {(min(a["node"], b["node"]), max(a["node"], b["node"])) for a in left for b in (right or left)}
    want = {(a[1], b[1]) for a in members for b in members if a[1] < b[1] and a[0] == b[0] and a[2] != b[2]}
    assert want <= met and not [p for p in met if p[1] < 60]
    assert max(sum(r["node"] == i for r in rows) for i in range(60)) == 3


def test_classes_with_many_rows(spark, monkeypatch):
    """Classes are found by broadcast, or by broadcast of the frequent and a shuffled join of the others."""
    rows = spark.createDataFrame([(i, f"k{i % 5}" if i > 50 else "hot" if i else None) for i in range(80)], "id long, key string")
    classes = written(spark.createDataFrame([("hot", 50, 1), *[(f"k{i}", 6, 2 + i) for i in range(4)]], "key string, copies long, c long"), "classes")
    want = sorted((i, None if i == 0 else 1 if i <= 50 else 2 + i % 5 if i % 5 < 4 else None) for i in range(80))
    for bound, hot in ((10, 10), (2, 10), (0, 10)):
        monkeypatch.setattr(K, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(K, "HOT_ROWS", hot)
        got = K.joined_by_class(rows, classes, "key", "copies").collect()
        assert sorted((r["id"], r["c"]) for r in got) == want


def test_license_containment(spark):
    rng = random.Random(2)
    fill = [f"w{i}" for i in range(300)]
    docs = []
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        around = [" ".join(rng.choices(fill, k=rng.randrange(0, 90))) for _ in range(2)]
        docs.append((i, f"{around[0]} {text.upper()}\n{around[1]}", name))
        words = text.split()
        docs.append((100 + i, f"{around[0]} {' '.join(words[: len(words) // 2])} {around[1]}", None))
    found = scan_licenses(spark.createDataFrame(docs, "doc_id long, text string, name string")).collect()
    got = {(r["doc_id"], r["license"]) for r in found}
    assert {(i, n) for i, _, n in docs if n} <= got
    import re

    def shingles(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(i, n) for i, t, _ in docs for n, x in TEMPLATES.items() if len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x))}
    assert got == want


def test_license_edited_copies(spark):
    """Copies with changed words, of templates of one shingle up to hundreds, from a table; short ones are one shingle."""
    rng = random.Random(15)
    made = {f"t{m}": " ".join(f"{rng.choice('abc')}{rng.randrange(900)}" for _ in range(m)) for m in (2, 3, 5, 6, 9, 13, 14, 30, 60, 400)}
    docs = []
    for name, text in made.items():
        words = text.split()
        for edits in (0, 0, 1, 2, len(words) // 30, len(words) // 25, len(words) // 20):
            own = list(words)
            for _ in range(edits):
                own[rng.randrange(len(own))] = "edited"
            docs.append((len(docs), " ".join([f"f{rng.randrange(99)}" for _ in range(rng.randrange(9))] + own + ["end"]), "x"))

    def shingles(words, k):
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    want = set()
    for i, text, _ in docs:
        for name, t in made.items():
            k = min(5, len(t.split()))
            whole = shingles(t.split(), k)
            if len(whole & shingles(text.split(), k)) >= 0.8 * len(whole):
                want.add((i, name))
    templates = spark.createDataFrame(list(made.items()) + [("none", None), ("empty", "")], "license string, text string")
    found = scan_licenses(spark.createDataFrame(docs, "doc_id long, text string, license string"), templates).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == want and len(found) == len(want) > 20


def test_html_articles():
    rng = random.Random(4)
    for _ in range(60):
        blocks = [" ".join(f"word{rng.randrange(99)}&<" for _ in range(rng.randrange(3, 60))) for _ in range(rng.randrange(1, 9))]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<p><b>{}</b>"]).format(html.escape(b)) for b in blocks)
        page = (
            '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script><style>p{}</style></head><body><!-- x -->'
            '<nav><ul><li><a href="/a">one</a></li></ul></nav><div class="ad">buy now</div><aside>see also these pages</aside>'
            f'<{rng.choice(["article", "main", "div"])} id="story">{body}</div></article></main>'
            '<div class="comments"><p>first comment, and long enough to look like text</p></div><form>mail <input></form>'
            '<footer>&copy; site &middot; words</footer></body></html>'
        )
        assert main_text(page) == " ".join(" ".join(blocks).split())


def test_mix_targets_and_takes(spark):
    rng = random.Random(6)
    docs = []
    for s, n in (("b", 400), ("a", 3000), (None, 200), ("c", 900), ("z", 5)):
        docs += [(len(docs) + i, s, " ".join(["w"] * rng.randrange(0, 80))) for i in range(n)]
    made = mix_sources(spark.createDataFrame(docs, "doc_id long, source string, text string"), word_count(F.col("text")), chunk_rows=128)
    rows = made.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in docs)
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free = {}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 2 * sizes[s] for s in over}
        free -= over
    taken = {}
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 1.5
    again = {r["doc_id"]: r["taken"] for r in mix_sources(spark.createDataFrame(docs[::-1], "doc_id long, source string, text string"), word_count(F.col("text")), chunk_rows=128).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    stems = ["loweik", "vequn", "chlla"]
    def doc(i):
        words = ["".join(rng.choices(["an", "er", "st", "th", "on", "ou", "le"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 150))]
        bad = rng.random() < 0.4
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["an", "er", "st", "th", "on", "ou"])
        return i, " ".join(words), int(bad)

    made = [doc(i) for i in range(700)]
    docs = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int")
    truth = {m[0]: m[2] for m in made}
    rows = toxicity_scores(docs, labels).collect()
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in out])
    assert right > 0.93


def test_chat_round_trip(spark):
    rng = random.Random(9)
    parts = ["<|im_end|>", "<|im_start|>", "\\", "<\\|", "<", "|", "\n", "é", "<|im_sep|>", "x"]
    rows, want = [], {}
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "a<|b\n"]), "".join(rng.choices(parts, k=rng.randrange(0, 8)))) for _ in range(rng.randrange(1, 9))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    rng.shuffle(rows)
    made = conversation_digests(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in made.collect()}
    assert got == want


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(10)
    docs = [(i, "".join(rng.choices(["The ", "quick ", "brøwn ", "  ", "\n", "123", "don't ", "<|endoftext|>"], k=rng.randrange(0, 300))), rng.choice("aab") if i % 9 else None) for i in range(80)]
    tokenizer = Tokenizer.from_file(tokenizer_file())
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t, _ in docs}
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = pack_documents(frame, tokenizer_file(), window=256, quantum=32).collect()
    at = {i: 0 for i in ids}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        x = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(x)
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert at == {i: len(x) for i, x in ids.items()}
    place = 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 256 + r["offset"] == place and r["offset"] + r["length"] <= 256
        place += r["length"]


def test_places_against_a_deficit_counter(spark):
    """The places of all quanta, computed at once, against serving the source that is furthest behind, one after the other."""
    rng = random.Random(16)
    quantum = 16
    sources = [(f"s{i:02}", rng.choice([5, 16, 40, 97, 97, 333, 1000]), rng.choice([1, 1, 2, 7, 20])) for i in range(40)]
    kind = lambda total, w: (w, -(-total // quantum))
    kinds, ranks = {}, {}
    for name, total, w in sources:
        n, tokens = kinds.get(kind(total, w), (0, 0))
        ranks[name] = n, tokens
        kinds[kind(total, w)] = n + 1, tokens + total
    rounds = Rounds([(*k, *v) for k, v in kinds.items()], quantum)
    left = {name: total for name, total, _ in sources}
    served = dict.fromkeys(left, 0)
    place, want = 0, {}
    while any(left.values()):
        # deficit: what a source's weight gives it by now, less what it has had
        name, total, w = min(
            (s for s in sources if left[s[0]]), key=lambda s: (Fraction(2 * served[s[0]] + 1, s[2]), s[2], -kind(s[1], s[2])[1], ranks[s[0]][0])
        )
        want[name, served[name]] = place
        given = min(quantum, left[name])
        left[name] -= given
        served[name] += 1
        place += given
    for name, total, w in sources:
        j = np.arange(-(-total // quantum))
        of = (np.full(len(j), x) for x in (*kind(total, w), *ranks[name]))
        assert rounds.start(j, *of).tolist() == [want[name, i] for i in j.tolist()]


@pytest.mark.parametrize(("n_sources", "how"), [(5000, {}), (4, {"proportions": {"q0": 5, "q1": 1, None: 2}}), (4, {"exponent": 0.5})])
def test_packing_by_proportions(spark, n_sources, how):
    """However many sources there are, every token has its place; windows hold the target shares while all sources last."""
    rng = random.Random(17)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 400 if n_sources < 9 else 3)), f"q{i % n_sources}" if i % n_sources != 2 else None) for i in range(6000 if n_sources > 9 else 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = pack_documents(frame, tokenizer_file(), window=512, quantum=64, **how).collect()
    place = 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 512 + r["offset"] == place and r["offset"] + r["length"] <= 512
        place += r["length"]
    source = {i: s for i, _, s in docs}
    sizes = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert place == sum(sizes.values()) and set(sizes) == set(source)
    if n_sources < 9:
        total = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in set(source.values())}
        share = {s: how["proportions"].get(s, 0) if "proportions" in how else total[s] ** 0.5 for s in total}
        share = {s: v / sum(share.values()) for s, v in share.items()}
        lasting = min(total[s] / v for s, v in share.items() if v) * 0.9
        got = dict.fromkeys(total, 0)
        for r in rows:
            if r["sequence_id"] * 512 < lasting:
                got[source[r["doc_id"]]] += r["length"]
        for s, n in got.items():
            assert abs(n - share[s] * sum(got.values())) <= 2 * 512


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/2?x", "http://b.net/es/9", "http://b.net/en/9", "http://B.NET/fr", "x.com/y",
    "http://com/", "http://example.com/en", "https://example.com?u=https://evil.net/es/x", "http://a.net#://b/es/", "http://a.net?://b/es/",
    "://", "http:///es/", "HTTP://A.net/es/://b/fr/", None, "",
]


def url_parts(url):
    """Host and path of a url, character by character."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    stop = next((i for i, c in enumerate(rest) if i >= end and c in "?#"), len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop]


def ruled(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def tree_purities(urls, rules, min_children=20, max_share=0.1, alpha=5.0, prior=0.5, z=1.96, alike=0.9):
    """Purity per (host, path) by loops over nodes: wildcards, then purities and merged branches from the hosts down."""
    paths = {}
    for url in urls:
        host, path = url_parts(url)
        segs = path.removeprefix("/").split("/", 3)
        row = paths.setdefault((host, tuple(segs + [""] * (4 - len(segs)))), [0, 0, 0])
        rule = ruled(host, path, rules)
        row[0] += 1
        row[1] += rule is not None
        row[2] += rule is not None and rule[2] == "block"
    names = {key: (key[0],) for key in paths}
    for d in range(4):
        kids = {}
        for key, row in paths.items():
            children = kids.setdefault(names[key], {})
            children[key[1][d]] = children.get(key[1][d], 0) + row[0]
        for key in paths:
            children = kids[names[key]]
            variable = len(children) >= min_children and children[key[1][d]] <= max_share * sum(children.values())
            names[key] += ("*" if variable else key[1][d],)
    node = {key: (key[0], ()) for key in paths}
    purity = {}
    for key in paths:
        rows = [r for k, r in paths.items() if k[0] == key[0]]
        purity[key] = (sum(r[2] for r in rows) + alpha * prior) / (sum(r[1] for r in rows) + alpha)
    for d in range(4):
        made = {}
        for at in set(node.values()):
            keys = [k for k in paths if node[k] == at]
            above = purity[keys[0]]
            branches = []
            for name in {names[k][d + 1] for k in keys}:
                own = [k for k in keys if names[k][d + 1] == name]
                shape = {}
                for k in own:
                    child = names[k][d + 2] if d < 3 else ""
                    shape[child] = shape.get(child, 0) + paths[k][0]
                labelled, bad = (sum(paths[k][i] for k in own) for i in (1, 2))
                p = (bad + alpha * above) / (labelled + alpha)
                lead = max((n, c) for c, n in shape.items())[1]
                branches.append((lead, p, name, p * (1 - p) / (labelled + alpha), shape, labelled, bad))
            groups = []
            for b in sorted(branches, key=lambda b: b[:3]):
                if groups:
                    before = groups[-1][-1]
                    total = sum(b[4].values()) * sum(before[4].values())
                    likeness = sum((n * before[4].get(c, 0)) ** 0.5 for c, n in b[4].items()) / total**0.5
                    if b[1] - before[1] <= z * (b[3] + before[3]) ** 0.5 and likeness >= alike - 1e-12:
                        groups[-1].append(b)
                        continue
                groups.append([b])
            for i, group in enumerate(groups):
                p = (sum(b[6] for b in group) + alpha * above) / (sum(b[5] for b in group) + alpha)
                for k in keys:
                    if names[k][d + 1] in {b[2] for b in group}:
                        made[k] = (at[0], (*at[1], i)), p
        node, purity = {k: m[0] for k, m in made.items()}, {k: m[1] for k, m in made.items()}
    return purity


def test_url_parts_and_rules(spark):
    made = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path = url_parts(u)
        best = ruled(host, path, URL_RULES)
        assert (made[i]["host"], made[i]["path"]) == (host, path)
        assert made[i]["rule"] == (best[1] if best else None) and (not best or made[i]["verdict"] == best[2])


def test_url_tree(spark):
    """Purities and verdicts against loops over the nodes, on hosts with wildcards, merged branches and few labels."""
    rng = random.Random(14)
    urls = list(URLS)
    for h in range(12):
        host = f"h{h}.{rng.choice(['example.net', 'example.com', 'example.org'])}"
        for _ in range(rng.choice([3, 15, 80])):
            lang = rng.choice(["en", "es", "fr", "de"])
            urls.append(f"http://{host}/{lang}/" + rng.choice(["{}", "{}.html", "user/{}/posts", "tag/{}", "a/b/c/{}/d", ""]).format(rng.randrange(400)))
    made = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()
    want = tree_purities(urls, URL_RULES)
    verdicts = set()
    for r in made:
        segs = r["path"].removeprefix("/").split("/", 3)
        p = want[r["host"], tuple(segs + [""] * (4 - len(segs)))]
        assert r["purity"] == pytest.approx(p), r
        if r["rule"] is None:
            assert r["verdict"] == ("block" if p > 0.7 else "allow")
            verdicts.add(r["verdict"])
    assert verdicts == {"allow", "block"}


def test_url_templates_learn_from_labels(spark):
    """Under a host, blocked and allowed branches get the verdicts of their labels; what varies is a wildcard."""
    urls = [f"http://h.io/spam/{i}/x" for i in range(60)] + [f"http://h.io/news/{i}/x" for i in range(60)]
    urls += [f"http://h.io/spam/{i}/y" for i in range(900, 905)] + ["http://other.io/spam/1/x"]
    rules = [("block", "h.io", f"/spam/{i}/") for i in range(40)] + [("allow", "h.io", f"/news/{i}/") for i in range(40)]
    made = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in made:
        assert r["verdict"] == ("block" if r["host"] == "h.io" and r["path"].startswith("/spam") else "allow")
    assert {r["template"] for r in made if r["host"] == "h.io"} >= {"/news/*/x"}


@pytest.mark.parametrize("block_mb", [32, 0.001])
def test_topk(spark, block_mb):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(400, 12)).astype(np.float32)
    v[50:120] = v[49]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    got = topk_search(frame, frame.where("vec_id % 20 = 0"), k=7, tile_rows=32, block_mb=block_mb).collect()
    e = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 400, 20):
        s = e @ e[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:7]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


@pytest.mark.parametrize("size", [2.0**21, 2.0**40, 1e200])
def test_topk_of_large_numbers(spark, size):
    """Scores beyond 53, 63 and hundreds of bits are exact; those that no long holds are null, in the right places."""
    rng = np.random.default_rng(int(np.log2(size)))
    v = [[float(x) for x in np.floor(size * rng.normal(size=3))] for _ in range(60)] + [[size + 1.0, 1.0, 0.0], [size + 1.0, 1.0, 1.0], [1.0, 2.0, 3.0]]
    frame = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").repartition(3)
    got = topk_search(frame, frame.where("vec_id % 6 = 0"), k=50, tile_rows=16, block_mb=0.0001, scale=1.0).collect()
    whole = [[int(x) for x in line] for line in v]
    want = []
    for q in range(0, len(v), 6):
        s = [sum(a * b for a, b in zip(x, whole[q], strict=True)) for x in whole]
        order = sorted((i for i in range(len(v)) if i != q), key=lambda i: (-s[i], i))[:50]
        want += [(q, r + 1, i, s[i] if -(2**63) <= s[i] < 2**63 else None) for r, i in enumerate(order)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want, key=lambda x: x[:2])


@pytest.mark.parametrize(("keep", "ranges"), [("min", 1), ("max", 40), ("min", 300)])
def test_exact_groups_over_many_ranges(spark, keep, ranges):
    """A group of a third of all rows lies in many ranges; its runs are joined where they meet."""
    rows = [(i, "same text") for i in range(900)] + [(i, f"t{i % 97}") for i in range(900, 1500)] + [(3000 + i, "") for i in range(300)] + [(5000 + i, f"same text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    made = exact_dedup(docs, keep=keep, ranges=ranges)
    text = dict(rows)
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        same = groups[text[r["doc_id"]]]
        best = (min if keep == "min" else max)(same)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(same), r["doc_id"] == best)
        assert r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
