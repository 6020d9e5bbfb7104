"""The pipeline against plain loops over a small table."""

import json
import random
import re
from collections import Counter

import numpy as np

from quarry.llm import quality, sentencepiece, shared, simhash, surrogates
from tests.llm.test_operators import words


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    repeat = len({k for j in range(len(w) - 7) if n[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)})
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols = max(1, sum(map(len, w))), sum(c in "#*$%&|<>" for c in text or "")
    vector = [np.log1p(len(w)), 2 * np.log(chars / max(1, len(w))), np.log1p(200 * symbols / chars), np.log1p(10 * (len(lines) - len(set(lines))) / max(1, len(lines))), np.sqrt(repeat / max(1, len(w)))]
    return vector, len(w) < 20 or 100 * repeat > 30 * len(w)


def mcd(x):
    """Mean and covariance of the smallest determinant that the documented starts and rounds reach."""
    floors, k = np.diag(list(quality.STATS.values())), len(x[0])
    rank = lambda v, q: np.sort(v, axis=0)[int(np.ceil(q * len(v))) - 1]
    m = rank(x, 0.5)
    d = np.sqrt((1.4826 * rank(np.abs(x - m), 0.5)) ** 2 + np.diag(floors))
    z = (x - m) / d
    found = []
    for y in (None, np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None], np.clip(z, -quality.CLIP, quality.CLIP)):
        corr = np.eye(k)
        if y is not None:
            p = y.T @ y / len(y)
            s = np.sqrt(np.outer(np.diag(p), np.diag(p)))
            corr = np.where(np.eye(k) > 0, 1.0, np.divide(p, s, out=np.zeros_like(p), where=s > 0))
        centre, cov, last = m, corr * np.outer(d, d), None
        for step in range(quality.SHORT + quality.ROUNDS):
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            core = x[d2 <= rank(d2, quality.CORE)]
            centre, cov = core.mean(axis=0), np.cov(core.T, bias=True) * quality.CONSISTENT + floors
            now = np.linalg.slogdet(cov)[1]
            if step == quality.SHORT - 1:
                early = now
            if last is not None and step >= quality.SHORT and abs(now - last) < quality.SETTLED:
                break
            last = now
        found.append((early, centre, cov))
    return min(found, key=lambda f: f[0])[1:]


def score(item, doc):
    """Smith-Waterman over words, in plain loops."""
    best, row = 0, [0] * (len(doc) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(doc, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def test_pipeline_equals_plain_loops(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece as sp

    r = random.Random(5)
    item = words(24, 800)
    texts = [words(r.randint(60, 240), i) for i in range(60)]
    texts += [texts[0], texts[1].replace(texts[1].split()[40], "changed", 1), "too short", None, "", " | ".join(words(3, i) for i in range(60)), (words(12, 5) + " ") * 12]
    copy = item.split()
    copy[5], copy[15] = "other", "thing"
    texts += [f"{words(70, 900)} {item.upper()}, {words(30, 901)}", f"{words(50, 902)} {' '.join(copy)} {words(50, 903)}", f"{words(80, 904)} {' '.join(item.split()[3:8])} {words(30, 905)}"]
    texts += [f"{words(60, 910)} write to jo.x@corp.org or +1 (663) 555-6869, Mr. John Smith said. Smith left {words(30, 911)}", f"{words(60, 912)} jo.x@corp.org again {words(30, 913)}"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs + [docs[2]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, words(18, 801))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = shared.cut_tables()
    got = {x.doc_id: (x.n_chars, list(x.ids)) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(shared.cut_tables()) - len(before) <= 1  # the tables of earlier stages are gone

    vectors = [statistics(t) for t in texts]
    usable = np.array([v for v, failed in vectors if not failed] + [vectors[2][0]])  # document 2 is there twice
    centre, cov = mcd(usable)
    kept = [i for i, (v, failed) in enumerate(vectors) if not failed and (np.array(v) - centre) @ np.linalg.inv(cov) @ (np.array(v) - centre) <= quality.CHI2_REJECT]
    assert len(kept) < len(texts) - 4 and set(range(60)) <= set(kept)

    prints = {i: simhash.fingerprint(texts[i]) for i in kept}
    least = {i: i for i in kept}
    for _ in kept:
        least = {i: min(least[j] for j in kept if (prints[i] ^ prints[j]).bit_count() <= 3) for i in kept}
    kept = [i for i in kept if least[i] == i]
    assert 60 not in kept

    tokens = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    tests = [tokens(item), tokens(words(18, 801))]
    leaky = {i for i in kept for t in tests if (s := score(t, tokens(texts[i]))) >= 0.6 * 2 * len(t) or s >= 26}
    assert len(leaky) == 2
    kept = [i for i in kept if i not in leaky]

    ref = sp.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    genders = {"john": "m"}
    want = {}
    for i in kept:
        new = texts[i]
        for s, e, kind, canon, _ in reversed(surrogates.entities(new)):
            new = new[:s] + surrogates.rendered(new[s:e], kind, surrogates.surrogate(surrogates.KEY, kind, canon, 0, genders.get(canon, "n"))) + new[e:]
        assert not any(x in new for x in ("corp", "6869", "John", "Smith"))
        want[i] = (len(new), ref.encode(new))
    assert json.dumps(got, sort_keys=True) == json.dumps(want, sort_keys=True)
