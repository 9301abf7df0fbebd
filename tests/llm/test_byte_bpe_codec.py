import base64
import random

import public_tokenizers as P
import tiktoken
from tessera.llm.byte_bpe import Codec

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_matches_library():
    enc, codec = library(), Codec(PATH, P.PATTERN)
    rng = random.Random(5)
    letters = "abcdefghilmnoprstuvwxyzéèñß  \n'.,01漢字😀"
    texts = ["", "a" * 5000, "ab" * 3000, "hello world's  end\n\n x", "<|endoftext|>", "aaaa aaa aa a", "0" * 777, "the " * 50]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(300)]
    texts += ["".join(rng.choices("aeinrst", k=rng.randint(1, 300))) for _ in range(200)]
    texts += ["a  b", "a   b", "a \n b", "a\n \nb", "x  ", " x", "  ", " ", "\n", "a \tb", "a\u00a0b c", "a \u00a0b", "it 's it's", "a\r\n b"]
    for t, c in zip(texts, codec.encode(texts), strict=True):
        import numpy as np

        assert np.frombuffer(c, "<u4").tolist() == enc.encode_ordinary(t), t[:50]
        assert codec.decode(c) == t.encode()
