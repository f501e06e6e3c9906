"""A circuit breaker that all tasks of a job share, by marks in a shared folder."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyarrow import fs


@dataclass
class Breaker:
    """Says before each call of an engine whether it may be made, and hears how it went.

    Closed until `most` calls have failed since the last good one; then open: nobody calls for rest_s
    seconds. After that one caller at a time may try (half open): if its call is good all go on,
    otherwise all rest again. State is the names of files in the folder, which every task can reach: a
    mark for each failure, for each try and for each good try. Calls that are under way when the breaker
    opens still end, so that at most most + tasks - 1 are made before it is known to be open. A task
    looks at the folder at most every look_s seconds while all is well. Clocks of machines may differ
    by what rest_s is apart from `look_s`; a task that dies during its try blocks others for rest_s.
    """

    folder: str
    most: int = 3
    rest_s: float = 30.0
    look_s: float = 1.0
    _seen: float = field(default=-1e9, repr=False)
    _trying: bool = field(default=False, repr=False)

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith(("/", "file:")) else (fs.LocalFileSystem(), self.folder)

    def _mark(self, kind: str) -> None:
        store, top = self._store()
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/{kind}-{time.time():.6f}-{uuid.uuid4().hex}") as f:
            f.write(b"x")

    def _marks(self) -> dict[str, list[tuple[float, str]]]:
        store, top = self._store()
        out: dict[str, list[tuple[float, str]]] = {"failed": [], "try": [], "good": []}
        for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            kind, at, own = f.base_name.split("-", 2)
            out[kind].append((float(at), own))
        return {k: sorted(v) for k, v in out.items()}

    def state(self) -> str:
        """closed, open or half open, as the marks have it now."""
        m = self._marks()
        since = m["good"][-1][0] if m["good"] else -1.0
        failed = [t for t, _ in m["failed"] if t > since]
        if len(failed) < self.most:
            return "closed"
        return "open" if time.time() - failed[-1] < self.rest_s else "half open"

    def allows(self) -> bool:
        now = time.monotonic()
        if not self._trying and now - self._seen < self.look_s:
            return True
        state = self.state()
        if state == "closed":
            self._seen, self._trying = now, False
            return True
        self._seen = -1e9
        if state == "open":
            return False
        # Half open: the first of the tries that are on their way goes on, the others see that they aren't it.
        own = uuid.uuid4().hex
        store, top = self._store()
        with store.open_output_stream(f"{top}/try-{time.time():.6f}-{own}") as f:
            f.write(b"x")
        m = self._marks()
        failed = m["failed"][-1][0]
        live = [x for x in m["try"] if x[0] > failed and time.time() - x[0] < self.rest_s]
        self._trying = bool(live) and live[0][1] == own
        return self._trying

    def told(self, good: bool) -> None:
        """How an allowed call went."""
        if not good:
            self._mark("failed")
            self._seen = -1e9
        elif self._trying:
            self._mark("good")
        self._trying = False
