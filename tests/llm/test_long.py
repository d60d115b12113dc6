"""Very long texts: memory a worker needs for one, by operator, and equal results however a text is cut."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent

BODY = r"""
import resource, sys
import numpy as np
sys.path.insert(0, %(root)r)
from skein.llm.text import *
n = %(size)d
rng = np.random.default_rng(1)
words = rng.integers(97, 123, (5000, 6)).astype(np.uint8)
words[:, 5] = 32
buf = words[rng.integers(0, 5000, n // 6)].ravel()
off = np.array([0, len(buf)])
def low():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
%(setup)s
before = low()
%(run)s
print("ADDED", (low() - before) * (1 << 20) / len(buf))
"""
CASES = {
    "op1": ("from skein.llm.licenses import Scanner\ns = Scanner()", "s.rows(buf, off)", 12),
    "op2": ("from skein.llm.simhash import fingerprint", "fingerprint(buf.tobytes())", 6),
    "op3": (
        "from skein.llm.decontaminate import *\nimport random\nr = random.Random(1)\nitems = Items([(k, ' '.join(bytes(words[r.randrange(5000)][:5]).decode() for _ in range(30))) for k in range(200)])\n"
        "items.weigh(np.full(len(items.words), 5), 100)\ns = Search(items, np.random.default_rng(2).normal(size=(len(items.words), 64)).astype(np.float32), 0.4, 0.6, 0.4)",
        "s.rows(buf, off)", 12,
    ),
    "op4": ("from skein.llm.substrings import runs", "runs(buf, off)", 12),
    "op5": ("from skein.llm.langid import Parser\np = Parser({'a': b'some words here' * 50, 'b': b'andere worte da' * 50})", "p.predict(buf, off)", 16),
    "op6": ("import public_tokenizers\nfrom skein.llm.tokens import WordTokenizer\nt = WordTokenizer(public_tokenizers.path('word_bpe_49k.json'))", "t.ids(buf.tobytes())", 10),
    "op8": ("from skein.llm.pii import *", "[all_spans(t, frozenset(['x'])) for _, t in rows(pa.array([buf.tobytes().decode() + '1'], pa.large_string()))]", 16),
    "op9": ("from skein.llm.toxicity import Lexicon\nx = Lexicon(hash_words(['abcde'], ALNUM), [1.0], np.zeros(4))", "x.score(buf, off)", 30),
    "op10": ("from skein.llm.quality import *", "statistics(buf, off)", 30),
}


@pytest.mark.parametrize("name", CASES)
def test_memory_of_one_long_text(name):
    setup, run, most = CASES[name]
    code = BODY % {"root": str(ROOT), "size": 24 << 20, "setup": setup, "run": run}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    used = float(re.search(r"ADDED ([-0-9.]+)", out.stdout)[1])
    print(name, used)
    assert used < most, f"{used:.1f} bytes a byte"


def test_hashes_of_long_words(monkeypatch):
    import numpy as np

    from skein.llm import text

    rng = np.random.default_rng(3)
    buf = rng.integers(97, 110, 5000).astype(np.uint8)
    buf[rng.integers(0, 5000, 60)] = 32
    off = np.array([0, 1200, 1200, 5000])
    want = text.Words(buf, off, text.ALNUM).hashes()
    monkeypatch.setattr(text, "LONG", 64)
    assert np.array_equal(text.Words(buf, off, text.ALNUM).hashes(), want)
    assert len(set(want.tolist())) > 50
