"""Calls with a deadline: a child process for each Python worker does the work, so that what hangs or crashes costs one row."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable

OK, ERROR, TIMEOUT, CRASH = "ok", "error", "timeout", "crash"


def _serve(pipe: object, call: Callable) -> None:
    while True:
        try:
            args = pipe.recv()
        except EOFError:
            return
        try:
            pipe.send((OK, call(*args)))
        except Exception as error:  # noqa: BLE001  the caller's code; its failure is an answer
            pipe.send((ERROR, str(error)))


class Caller:
    """Calls a function in a child process that is forked when it is needed and again after it was lost."""

    def __init__(self, call: Callable, seconds: float) -> None:
        self.call, self.seconds, self.child, self.pipe = call, seconds, None, None

    def _begin(self) -> None:
        fork = multiprocessing.get_context("fork")
        self.pipe, theirs = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(theirs, self.call), daemon=True)
        self.child.start()
        theirs.close()

    def __call__(self, *args: object) -> tuple[str, object]:
        """(ok, result), (error, message), (timeout, message) or (crash, message with the exit code)."""
        if self.child is None:
            self._begin()
        try:
            self.pipe.send(args)
            if not self.pipe.poll(self.seconds):
                self.close()
                return TIMEOUT, f"no answer within {self.seconds:g} s"
            return self.pipe.recv()
        except (EOFError, OSError):
            self.child.join(5)
            code = self.child.exitcode
            self.close()
            return CRASH, f"exit code {code}"

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
        self.child = self.pipe = None
