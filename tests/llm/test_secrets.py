"""Secret scan on texts with very many matches, over the borders of blocks."""

import base64
import hashlib
import math
import re
import time
from collections import Counter

from textdrift.llm import secrets


def _many(n, seed):
    return [hashlib.sha256(f"{seed}{i}".encode()).hexdigest()[:24 + i % 9] for i in range(n)]


def _windows(text, bits, size):
    """Merged windows of high entropy in the words of a text."""
    spans = []
    for word in re.finditer(r"\S+", text):
        for i in range(word.start(), word.end() - size + 1):
            if -sum(c / size * math.log2(c / size) for c in Counter(text[i:i + size]).values()) >= bits - 1e-9:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
    return [tuple(s) for s in spans]


def test_many_matches(spark):
    hexes = _many(20_000, "a")
    keys = [k for h in _many(900, "b") if re.search("[0-9]", k := re.sub("[^A-Za-z0-9]", "Q", base64.b64encode(bytes.fromhex(h[:24]) * 2)[:18].decode()) + h[:9] + "xYz")]
    texts = ["漢 " + " x ".join(hexes), " ".join(keys), " ".join(f"token: {k} {h}" for k, h in zip(keys, hexes)),
             "EXAMPLE-".join(keys[:600])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    at = time.time()
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert time.time() - at < 60
    for i, text in enumerate(texts):
        want = [(m.start(), k, m.end()) for k, (_, p, least) in enumerate(secrets.KINDS) for m in re.finditer(p, text) if len(m[1]) >= least]
        assert [(s["start"], s["ord"], s["end"]) for s in got[i]["base"]] == sorted(want)
        base = {x for s in got[i]["base"] for x in range(s["start"], s["end"])}
        added = [(s["start"], s["end"]) for s in got[i]["added"]]
        assert added == sorted(added) and not any(x in base for a, b in added for x in range(a, b))
    assert len(got[0]["added"]) == 0 and len(got[0]["base"]) == len(hexes)
    assert len(got[2]["base"]) == 2 * len(keys)
    want = _windows(texts[1], secrets.CLASSES[1][3], secrets.WINDOW)
    assert len(want) > 2 * secrets.BLOCK and [(s["start"], s["end"]) for s in got[1]["added"]] == want
