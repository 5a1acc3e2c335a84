import random
import zlib
from collections import Counter, defaultdict
from struct import pack

import pytest
from tokenizers import Tokenizer

from cinelake.llm import packing
from cinelake.llm.queries import tokenizer_path


def best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 60), rng.randint(1, 10), 25]) for _ in range(rng.randint(0, 300))]
    counts = Counter(lengths)
    held, placed = defaultdict(list), Counter()
    for length, rank, sequences, each, first, offset in packing.best_fit_plan(counts, 60):
        assert rank == placed[length]
        placed[length] += sequences * each
        for s in range(sequences):
            for i in range(each):
                held[first + s].append((offset + i * length, length))
    assert placed == counts
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 60
    assert sorted(60 - sum(n for _, n in p) for p in held.values()) == best_fit(lengths, 60)


def test_pieces_and_places(spark):
    rng = random.Random(3)
    words = ["The", "the,", "don't", "Ä", "naïve", "éa", "12a", "!!", "<|endoftext|>", "日本語", "x\x1cy", " ", "\x1e", "ABCdef", "ΑΣ", "😀", "a" * 90]
    texts = [None, "", " ", "a"] + ["".join(rng.choice(words) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += texts[5:30] + ["word " * 700]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame([(i if i != 7 else None, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, length int").repartition(4)
    rows = packing.pack_documents(docs, tokenizer_path(), capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want = [(n, a, len(ids[a : a + 64]), zlib.crc32(pack(f"<{len(ids[a : a + 64])}I", *ids[a : a + 64]))) for n, a in enumerate(range(0, len(ids), 64))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i if i != 7 else None]) == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    lengths = [r["length"] for r in rows]
    assert len(by_sequence) == len(best_fit(lengths, 64))


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path()).count() == 0
