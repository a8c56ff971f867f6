"""A function of bytes in a child of its own, whose memory is bounded by the size of its input."""

from __future__ import annotations

import os
import pickle
import resource
import signal
from collections.abc import Callable

#: Bytes that a child may take beyond what its parent has: so many, and so many for each byte of input.
BASE, EACH = 256 << 20, 64
#: Seconds after which a child is ended.
LONGEST = 900


def limited(f: Callable[[bytes], object], data: bytes):
    """``f(data)``, or ValueError where the child runs out of memory or dies: that is the file's own trouble."""
    there, here = os.pipe()
    child = os.fork()
    if child == 0:
        code = 1
        try:
            os.close(there)
            with open("/proc/self/statm") as own:
                now = int(own.read().split()[0]) * resource.getpagesize()
            signal.signal(signal.SIGALRM, signal.SIG_DFL)
            signal.alarm(LONGEST)
            resource.setrlimit(resource.RLIMIT_AS, (now + BASE + EACH * len(data),) * 2)
            try:
                answer = True, f(data)
            except MemoryError:
                answer = False, "needs more memory than a file of its size may"
            except Exception as e:
                answer = False, f"{type(e).__name__}: {e}"[:200]
            with os.fdopen(here, "wb") as out:
                out.write(pickle.dumps(answer))
            code = 0
        finally:
            os._exit(code)
    os.close(here)
    with os.fdopen(there, "rb") as answered:
        raw = answered.read()
    _, status = os.waitpid(child, 0)
    if status or not raw:
        raise ValueError(f"the examination ended with status {status}")
    good, answer = pickle.loads(raw)
    if not good:
        raise ValueError(answer)
    return answer
