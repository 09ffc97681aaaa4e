"""python -m loomtok train | encode | decode | benchmark"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtok import __version__
from loomtok.config import EncodingMode, SpecialTokensConfig
from loomtok.sources.models import read_text
from loomtok.tokenizer import Tokenizer


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomtok")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="train on text files and save a model folder")
    t.add_argument("input"), t.add_argument("output")
    t.add_argument("--vocab-size", type=int, default=30_000), t.add_argument("--min-frequency", type=int, default=2)
    t.add_argument("--mode", choices=[m.value for m in EncodingMode], default="ByteLevel")
    t.add_argument("--bos"), t.add_argument("--eos"), t.add_argument("--lines", action="store_true")
    for name in ("encode", "decode"):
        c = sub.add_parser(name)
        c.add_argument("model"), c.add_argument("input", help="a text, or ids parted by commas; - reads standard input")
        c.add_argument("--output"), c.add_argument("--special", action="store_true")
    b = sub.add_parser("benchmark", help="tokens a second over text files")
    b.add_argument("model"), b.add_argument("input"), b.add_argument("--iterations", type=int, default=3)
    a = p.parse_args(argv)
    if a.command in ("encode", "decode"):
        given = sys.stdin.read() if a.input == "-" else a.input
        tok = Tokenizer.load(a.model)
        said = " ".join(map(str, tok.encode(given, a.special))) if a.command == "encode" else tok.decode([int(x) for x in given.split(",")], not a.special)
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(said)
        else:
            print(said)
        return 0
    spark = SparkSession.builder.appName("loomtok").getOrCreate()
    docs = read_text(spark, a.input, not getattr(a, "lines", False))
    if a.command == "train":
        tok = Tokenizer.builder().vocab_size(a.vocab_size).min_frequency(a.min_frequency).encoding_mode(EncodingMode(a.mode)).with_special_tokens(SpecialTokensConfig(bos=a.bos, eos=a.eos)).build()
        tok.fit(docs).save(a.output)
        print(f"{tok.vocab_size} tokens in {a.output}")
        return 0
    ids = Tokenizer.load(a.model).encode_frame(docs).agg(F.sum(F.size("ids")).alias("n"))
    for _ in range(a.iterations):
        began = time.time()
        n = ids.first().n or 0
        print(f"{n} tokens, {n / (time.time() - began):.0f} tokens a second")
    return 0


if __name__ == "__main__":
    sys.exit(main())
