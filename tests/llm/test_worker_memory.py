"""What a Python worker holds while it encodes, measured in a process of its own."""
import subprocess
import sys
from pathlib import Path

from tidespine.llm import queries

PROBE = """
import random, re, sys
import pyarrow as pa
sys.path.insert(0, sys.argv[1])
from tidespine.llm import bpe, vocab

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rnd = random.Random(5)
words = ["".join(rnd.choice("aeinrsthlodcumpgb") for _ in range(rnd.randrange(3, 12))) for _ in range(120_000)]
batches = [pa.record_batch([pa.array([" ".join(rnd.choices(words, k=400)) for _ in range(1000)])], names=["text"]) for _ in range(4)]
definition = vocab.read_definition(sys.argv[2])
before, most, texts = held(), 0, 0
for part, ids, back in bpe.encoded(batches, "text", definition):
    texts, most = texts + part.num_rows, max(most, held() - before)
print(texts, most)
"""


def test_encoding_worker_stays_small():
    got = subprocess.run([sys.executable, "-c", PROBE, str(Path(__file__).resolve().parents[2]), queries.vocabulary()], capture_output=True, text=True, check=True)
    texts, most = got.stdout.split()
    assert int(texts) == 4000 and float(most) < 125
