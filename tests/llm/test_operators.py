"""The operators of factorloom.llm against brute force, and on odd input."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import bpe, decontaminate, exact_dedup, html_extract, line_dedup, quality, simhash, substring_dedup, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, repeated rows, ties, odd characters.
ODD = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "no id"), (None, None), (4, "é　x y 😀\n"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a  b c\nd e f"), (7, "a b c d e f" + " "), (8, "word " * 40000), (9, "\x00\x1c\x85")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA).withColumn("t", F.lit(1)).withColumn("h", F.lit("clash")).withColumn("w", F.lit(2.0))


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(7)) + "."
    out = []
    for d in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))).capitalize() + rng.choice([".", "!", ""]) for _ in range(rng.randint(1, 9))]
        x = rng.random()
        if x < 0.25:
            lines.insert(rng.randint(0, len(lines)), passage)
        text = "\n".join(lines)
        if out and x > 0.6:
            text = rng.choice(out)[1]
            if x > 0.7 and text:
                i = rng.randrange(len(text))
                text = text[:i] + rng.choice(["", "q", text[i] + "z"]) + text[i + 1 :]
        out.append((d, text))
    rng.shuffle(out)
    return out


def empty(spark):
    return frame(spark, ODD).limit(0)


def test_exact(spark):
    for rows, bits, part in ((ODD, 62, 1 << 22), (corpus(), 62, 1 << 22), (corpus(), 3, 1 << 22), (ODD, 62, 5), (corpus(), 62, 40), (corpus(), 3, 100)):
        got = exact_dedup.exact_groups(frame(spark, rows), fingerprint_bits=bits, part=part).collect()
        body = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups: dict = {}
        for d, t in rows:
            groups.setdefault(body(t), []).append((-len(t or ""), d is not None, d or 0))
        assert len(got) == len(rows)
        by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for r in got:
            g = by[r.text_sha256]
            assert r.group_size == len(g) and (min(g)[2] if min(g)[1] else None) == r.keep_id
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    a, b = b"x" * 9000, b"tail"
    for i, (mod, base) in enumerate(exact_dedup.FIELDS):
        assert exact_dedup.fingerprint(a + b)[i] == exact_dedup.combine(exact_dedup.fingerprint(a)[i], exact_dedup.fingerprint(b)[i], len(b), mod, base)
        assert exact_dedup.fingerprint(a)[i] == int.from_bytes(b"\0", "big") + sum(120 * pow(base, k, mod) for k in range(9000)) % mod


def components(prints):
    out = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = out[i], out[j]
                out = [min(a, b) if x in (a, b) else x for x in out]
    return out


def test_simhash(spark):
    for rows in (ODD, corpus(80)):
        got = simhash.simhash_groups(frame(spark, rows)).collect()
        prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
        roots = components(prints)
        least: dict = {}
        for (d, _), r in zip(rows, roots):
            if d is not None:
                least[r] = min(d, least.get(r, d))
        want = sorted((str(d), f"{p:016x}", str(least.get(r))) for (d, _), p, r in zip(rows, prints, roots))
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_trie_links_dense_and_sparse():
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(1500)}
    for _ in range(30):
        c = rng.getrandbits(64)
        values |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(30)}
    values = np.array(sorted(values), dtype=np.uint64)
    forest = simhash._Forest(len(values))
    simhash.links(values, 0, 63, 3, 0, forest)
    assert forest.parent.tolist() == components([int(v) for v in values])
    left, right = values[values >> np.uint64(63) == 0], values[values >> np.uint64(63) == 1]
    both = simhash._Forest(len(values))
    simhash.links(np.concatenate([left, right]), len(left), 62, 3, 1, both)
    for i in range(len(left)):
        for j in range(len(left), len(values)):
            if int(values[i] ^ values[j]).bit_count() <= 3:
                assert both.parent[i] == both.parent[j]


def test_suffix(spark):
    rng = random.Random(2)
    for rows in (ODD, corpus(70), [(1, "ab" * 300), (2, "ba" * 150), (3, "x" * 199), (4, "x" * 200)], [(d, "".join(rng.choice("ab") for _ in range(400))) for d in range(5)]):
        texts = [(t or "").encode() for _, t in rows]
        seen: dict = {}
        for t in texts:
            for i in range(len(t) - 199):
                seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
        want = []
        for (d, _), t in zip(rows, texts):
            cover = np.zeros(len(t) + 200, bool)
            for i in range(len(t) - 199):
                if seen[t[i : i + 200]] > 1:
                    cover[i : i + 200] = True
            cover = cover[: len(t)]
            spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
            want.append((str(d), len(t), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest()))
        for many in (2000, 1):
            got = suffix_dedup.removed(frame(spark, rows), many=many).collect()
            assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert suffix_dedup.removed(empty(spark)).count() == 0


def test_bpe(spark):
    import base64

    import public_tokenizers
    import tiktoken

    data = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = ODD + corpus(20) + [(100, "a" * 3000 + "=" * 500 + "abcab" * 300), (101, "<|endoftext|> ½² naïve 日本")]
    got = bpe.digests(frame(spark, rows), with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), str(tool.encode_ordinary(t or ""))) for d, t in rows)
    assert sorted((str(r.doc_id), str(r.ids)) for r in got) == want
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert bpe.encode(frame(spark, rows)).select(F.size("ids")).count() == len(rows)
    assert bpe.digests(empty(spark)).count() == 0


def test_decontaminate(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(12)] + [(20, "two words"), (21, ""), (22, None), (None, "lone"), (0, "another text of the same id it has")]
    docs = list(ODD)
    for d in range(40, 90):
        words = [word() for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.6:
            part = (rng.choice(items)[1] or "").split()
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, rng.choice([" ", "\n", ", "]).join(words).title()))

    def grams(t, n):
        w = "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
        return w, {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        w, _ = grams(t, 1)
        n = min(5, len(w))
        if n:
            q = grams(t, n)[1]
            want |= {(d, i) for d, text in docs if len(q & grams(text, n)[1]) >= 0.8 * len(q) - 1e-9}
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(0)).withColumn("doc_id", F.lit(5))
    got = decontaminate.matches(frame(spark, docs), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 10
    assert decontaminate.clean(frame(spark, docs), table).count() == sum(d not in {x for x, _ in want} for d, _ in docs)
    assert decontaminate.matches(empty(spark), table).count() == 0
    assert decontaminate.matches(frame(spark, docs), table.limit(0)).count() == 0


def test_substring(spark):
    for rows in (ODD, corpus(70)):
        unique = {(d, t or "") for d, t in rows}
        first, want = {}, {}
        th = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in unique], "t string").select("t", F.xxhash64(F.lit(2), F.encode("t", "utf-8")).alias("h")).collect()}
        for d, t in sorted(unique, key=lambda x: (x[0] is not None, x[0] or 0, th[x[1]])):
            parts = substring_dedup.sentences(t)
            assert "".join(parts) == t or not parts
            lines = [" ".join(p.split()) for p in parts]
            gone = set()
            for i in range(max(1, len(parts) - 2) if parts else 0):
                run = tuple(lines[i : i + 3])
                if sum(len(x.split()) for x in run) >= 8:
                    if run in first:
                        gone |= set(range(i, min(i + 3, len(parts))))
                    first.setdefault(run, d)
            want[d, t] = "".join(p for i, p in enumerate(parts) if i not in gone) if gone else t
        got = substring_dedup.dedup_spans(frame(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(d), want[d, t or ""]) for d, t in rows)
    assert substring_dedup.dedup_spans(empty(spark)).count() == 0


def within_one(a, b):
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    return len(a) - len(b) <= 1 and any(a[:i] == b[:i] and a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:]) for i in range(len(a)))


def test_lines(spark):
    hot = [(1000 + i, "one line that very many of them share\nsame but for a letter " + "abcdefgh"[i % 8] + " at the end") for i in range(24)]
    for rows in (ODD, corpus(60), hot):
        unique = {(d, t or "") for d, t in rows}
        th = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in unique], "t string").select("t", F.xxhash64(F.lit(3), F.col("t")).alias("h")).collect()}
        seen, want = [], {}
        for d, t in sorted(unique, key=lambda x: (x[0] is not None, x[0] or 0, th[x[1]])):
            kept = []
            for x in t.split("\n"):
                gone = x.strip(line_dedup.BLANK) and any(within_one(x, y) for y in seen)
                if x.strip(line_dedup.BLANK):
                    seen.append(x)
                if not gone:
                    kept.append(x)
            want[d, t] = "\n".join(kept)
        got = line_dedup.dedup_lines(frame(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.text or "", r.h) for r in got) == sorted((str(d), want[d, t or ""], "clash") for d, t in rows)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x", "https://x.example.net/de/81#t", "https://net/de/", "http://example.network/de/1", "https://a.b.org:80/es/1", "https://a.org/es/2", "http://com?/en/", "http://a.com/en/://b", "http://.com/en/x", "http://com./en/x", "ftp://example.com/en/8"] * 2
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, key int")
    for rules in (list(url_filter.RULES), [("com", "", "block"), ("example.com", "/", "allow"), ("a.example.com", "/en", "block"), ("", "/", "block"), (None, "/", "block")]):
        got = url_filter.judge(pages, url_filter.rule_table(spark, rules), ranges=3).collect()
        assert len(got) == len(urls)
        for r in got:
            u = urls[r.page_id] or ""
            rest = u.split("://", 1)[1] if "://" in u else ""
            front = rest.split("?")[0].split("#")[0]
            host = front.split("/")[0].lower()
            path = front[len(host) :]
            fit = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert url_filter.judge(pages, url_filter.rule_table(spark, []) if False else url_filter.rule_table(spark).limit(0)).where("verdict = 'allow'").count() == len(urls)


def test_html(spark):
    model = html_extract.train()
    right = total = 0
    for page in html_extract.labelled_pages(120, seed=77):
        tree = html_extract.parse(page)
        state, p = html_extract.states(tree), model.marginals(tree)
        leaves = [i for i, t in enumerate(tree.tag) if t == "#text"]
        right += sum((p[i] > 0.5) == (state[i] == 1) for i in leaves)
        total += len(leaves)
    assert right / total > 0.97
    page = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div><article><h1>A &amp; B&eacute;</h1><p><b>One\n two<br><p>Three  <a href=y>four</a></p><ul><li>five<li>six</ul></article><aside>side</aside><footer>&copy; x'
    assert model.extract(page) == "A & Bé\nOne two\nThree four\nfive\nsix"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<<<p <a href='"), (4, "u", "<div>" * 20000 + "deep")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0)), model=model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 2] == [""]


def test_marginals_are_exact():
    model = html_extract.train(html_extract.labelled_pages(60))
    tree = html_extract.parse("<body><div class=content><p>some words here<div class=ad>x</div></div></body>")
    n = len(tree.tag)
    import itertools
    import math

    weight = lambda s: math.prod(model.edges[s[tree.parent[i]]][s[i]] * math.exp(sum(model.known.get(f, (0, 0, 0))[s[i]] for f in html_extract.features(tree, i))) for i in range(1, n))
    states = [s for s in itertools.product(range(3), repeat=n) if s[0] != 1 and all(not (tree.tag[i] == "#text" and s[i] == 2) for i in range(n))]
    total = sum(map(weight, states))
    got = model.marginals(tree)
    for i in range(1, n):
        assert got[i] == pytest.approx(sum(weight(s) for s in states if s[i] == 1) / total, rel=1e-6)


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for d in range(400):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(3, 60))]
        bad = rng.random() < 0.3
        rows.append((d, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((d, 0 if bad else 1))
    docs, table = frame(spark, rows + ODD), spark.createDataFrame(labels + [(5, None), (None, 1), (0, 7)], "doc_id long, quality int")
    model = quality.train(docs, table)
    got = quality.scores(docs, model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 10]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality.keep_good(docs, model).count() == sum(r.predicted for r in got)
    assert quality.scores(docs.limit(0), model).count() == 0
    assert quality.train(docs, table.limit(0)).score(set()) == 0.5
