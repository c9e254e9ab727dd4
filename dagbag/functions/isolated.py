"""Python functions that may hang or crash, run in processes of their own."""

from __future__ import annotations

import os
import pickle
import select
import struct
import subprocess
import sys
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from queue import SimpleQueue
from typing import Any

from pyspark import cloudpickle

#: Seconds that a child has to start.
START = 60
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _put(pipe, x: Any) -> None:
    raw = cloudpickle.dumps(x)
    pipe.write(struct.pack("<Q", len(raw)) + raw)
    pipe.flush()


def _take(pipe) -> Any:
    head = pipe.read(8)
    if len(head) < 8:
        raise EOFError
    return pickle.loads(pipe.read(struct.unpack("<Q", head)[0]))


def _serve() -> None:
    """The child: a function first, then values; answers are (ok, result, peak MB)."""
    import resource

    given, answers = sys.stdin.buffer, os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)  # what the function prints is no answer
    f = _take(given)
    _put(answers, None)  # ready
    while True:
        try:
            x = _take(given)
        except EOFError:
            return
        try:
            ok, out = True, f(x)
        except Exception as e:  # whatever f raises is its answer
            ok, out = False, repr(e)
        _put(answers, (ok, out, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024))


class Isolated:
    """Call f on values in a child process; a call that takes longer than
    ``seconds``, or kills the child, gives ``default`` and a fresh child.

    An exception of f gives ``default``, too.  The child serves many calls, so a
    pandas UDF can hold one for its batch.  It is started anew, not forked, since
    the parent may have threads.  ``peak_mb`` is the most memory a child had so far.
    """

    def __init__(self, f: Callable[[Any], Any], seconds: float, default: Any = None):
        self.f, self.seconds, self.default, self.peak_mb = f, seconds, default, 0.0
        self.child: subprocess.Popen | None = None

    def _start(self) -> None:
        env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [_ROOT, os.environ.get("PYTHONPATH")]))}
        self.child = subprocess.Popen([sys.executable, "-c", "from dagbag.functions.isolated import _serve; _serve()"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env)
        _put(self.child.stdin, self.f)
        if not select.select([self.child.stdout], [], [], START)[0]:
            raise RuntimeError("the child doesn't start")
        _take(self.child.stdout)

    def __call__(self, x: Any) -> Any:
        try:
            if self.child is None:
                self._start()
            _put(self.child.stdin, x)
            if select.select([self.child.stdout], [], [], self.seconds)[0]:
                ok, out, peak = _take(self.child.stdout)
                self.peak_mb = max(self.peak_mb, peak)
                return out if ok else self.default
        except (EOFError, OSError):
            pass
        self.close()
        return self.default

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.wait()
            self.child.stdin.close()
            self.child.stdout.close()
            self.child = None

    def __enter__(self) -> Isolated:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Pool:
    """Several children: values are dealt to whichever is free, results keep their order."""

    def __init__(self, f: Callable[[Any], Any], seconds: float, default: Any = None, size: int = 4):
        self.workers = [Isolated(f, seconds, default) for _ in range(size)]

    def map(self, values: Iterable[Any]) -> list[Any]:
        free: SimpleQueue[Isolated] = SimpleQueue()
        for w in self.workers:
            free.put(w)

        def one(x: Any) -> Any:
            w = free.get()
            try:
                return w(x)
            finally:
                free.put(w)

        with ThreadPoolExecutor(len(self.workers)) as threads:
            return list(threads.map(one, values))

    @property
    def peak_mb(self) -> float:
        return max(w.peak_mb for w in self.workers)

    def __enter__(self) -> Pool:
        return self

    def __exit__(self, *_: object) -> None:
        for w in self.workers:
            w.close()
