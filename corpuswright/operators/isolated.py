"""Token ids by a process of their own: a text that crashes the library or never ends costs that text, not the task.

Texts and ids go through pipes in frames: four bytes of length, little-endian,
then UTF-8 text or unsigned 32-bit ids.  A process that dies or takes longer than
the limit is started again, and its text counts as unencodable (null ids).

Defined results: null and blank texts have no ids; a text over LARGEST bytes and
one with an id over 16 bits are unencodable.
"""

from __future__ import annotations

import os
import select
import struct
import subprocess
import sys
import time
from collections.abc import Iterator

#: Seconds for a text, bytes of a frame.
TIMEOUT, LARGEST = 120.0, 32 << 20


class Encoder:
    """command: a program that answers each text's frame with a frame of ids."""

    def __init__(self, command: list[str], timeout: float = TIMEOUT):
        self.command, self.timeout, self.restarts, self.process = command, timeout, 0, None

    def _read(self, n: int, until: float) -> bytes:
        out = bytearray()
        fd = self.process.stdout.fileno()
        while len(out) < n:
            ready, _, _ = select.select([fd], [], [], max(0.0, until - time.monotonic()))
            part = os.read(fd, n - len(out)) if ready else b""
            if not part:
                raise TimeoutError("no answer" if not ready else "closed")
            out += part
        return bytes(out)

    def _write(self, body: bytes, until: float) -> None:
        fd, at = self.process.stdin.fileno(), 0
        while at < len(body):
            _, ready, _ = select.select([], [fd], [], max(0.0, until - time.monotonic()))
            if not ready:
                raise TimeoutError("not taken")
            at += os.write(fd, body[at : at + select.PIPE_BUF])

    def encode(self, text: str) -> list[int] | None:
        body = text.encode("utf-8", "replace")
        if len(body) > LARGEST:
            return None
        if self.process is None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0)
        until = time.monotonic() + self.timeout
        try:
            self._write(struct.pack("<I", len(body)) + body, until)
            n = struct.unpack("<I", self._read(4, until))[0]
            if n > LARGEST or n % 4:
                raise ValueError("bad frame")
            ids = list(struct.unpack(f"<{n // 4}I", self._read(n, until)))
        except (OSError, ValueError):  # TimeoutError and BrokenPipeError are OSErrors
            self.restarts += 1
            self.close()
            return None
        return ids if not ids or max(ids) <= 0xFFFF else None

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            for pipe in (self.process.stdin, self.process.stdout):
                pipe.close()
            self.process = None


def command(path: str) -> list[str]:
    return [sys.executable, "-P", os.path.abspath(__file__), path]


def encode(docs, path: str, text: str = "text", timeout: float = TIMEOUT):
    """Add ids (null where a text can't be encoded) to every row; one process for each task."""
    import pandas as pd
    from pyspark.sql import functions as F

    from corpuswright.functions.text import sanitize

    schema = docs.withColumn("ids", F.array(F.lit(0))).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Encoder(command(path), timeout)
        try:
            for pdf in frames:
                yield pdf.assign(ids=[[] if x is None or not x.strip() else own.encode(x) for x in pdf[text]])
        finally:
            own.close()

    return sanitize(docs, text).mapInPandas(run, schema)


def _serve(path: str) -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, take, give = Tokenizer.from_file(path), sys.stdin.buffer, sys.stdout.buffer
    while len(head := take.read(4)) == 4:
        ids = tokenizer.encode(take.read(struct.unpack("<I", head)[0]).decode("utf-8", "replace"), add_special_tokens=False).ids
        give.write(struct.pack("<I", 4 * len(ids)) + struct.pack(f"<{len(ids)}I", *ids))
        give.flush()


if __name__ == "__main__":
    _serve(sys.argv[1])
