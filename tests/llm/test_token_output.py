import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from quarrylens.llm import token_output as O
from quarrylens.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "   x", "a  b", "a   b", "x \n y", "x\n  y", "x  \ny", "end ", "end  ", "\n\n a\n", "don't we'll I'm", "tab\t two", "é ñ ß 中文 字", "a b  c", "12 345 6x", "<|endoftext|> x<|endoftext|>",
    "!!! ?? .", "a" * 5000, "word " * 3000, "\x1c \x1d", "  em", "🙂 🙂🙂",
]


def encoder(**kw):
    with open(PATH, encoding="utf-8") as f:
        return O.ChunkEncoder(f.read(), **kw)


def direct(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunks_give_the_library_s_ids():
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["a", "The", " ", " ", "\n", "  ", ".", "'s", "é", "7", "\t", "中", ",", "!!", "\x1c", "\xa0", "<|endoftext|>"]) for _ in range(r.randrange(60))) for _ in range(600)]
    for e in (encoder(), encoder(most=5), encoder(most_chars=9), encoder(part_chars=200), encoder(part_chars=1)):
        for at in range(0, len(texts), 100):
            part = texts[at : at + 100]
            got = []
            for _, _, ids, sizes in e.parts(pa.array(part)):
                got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
            assert got == direct(part)


def run(spark, rows, **kw):
    folder = scratch_path(spark, "tokens")
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string")
    shards = O.write_token_files(docs, PATH, folder, **kw)
    return folder, shards, O.read_token_docs(spark, shards, folder).orderBy("start").collect()


def test_round_trip(spark):
    rows = [(i, t, 0, "x") for i, t in enumerate(ODD)] + [(None, "null id", 0, ""), (7, "again", 0, ""), (7, "again", 0, ""), (900, None, 0, "")]
    random.Random(1).shuffle(rows)
    folder, _, got = run(spark, rows, seq_len=16, batch_sequences=3)
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*direct([text or ""])[0], 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_empty_table_and_empty_texts(spark):
    assert run(spark, [])[2] == []
    assert [(r.n_tokens, r.start) for r in run(spark, [(1, None, 0, ""), (2, "", 0, "")])[2]] == [(1, 0), (1, 1)]


def test_sequences_are_mapped_at_random(spark):
    folder, shards, _ = run(spark, [(i, f"some words {i} " * 9, 0, "") for i in range(40)], seq_len=16, batch_sequences=3)
    for name in [r["name"] for r in shards.collect()]:
        path = f"{folder.removeprefix('file://')}/{name}.ids.arrows"
        with pa.memory_map(path) as m:
            table = pa.ipc.open_stream(m).read_all()
        flat = table["input_ids"].to_pylist()
        file = O.SequenceFile(path)
        for i in range(len(flat) - 1, -1, -1):
            ids, mask = file[i]
            assert ids.tolist() == flat[i] and mask.to_pylist() == table["mask"][i].as_py()
            assert not ids.flags.owndata
        assert all(all(m) for m in table["mask"].to_pylist()[:-1])
    assert json.dumps(O.END_ID) == "2"
