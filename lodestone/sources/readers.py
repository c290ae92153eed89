"""Spark data sources: the history of a repository, as a batch or a stream, and pages of issues.

    spark.dataSource.register(HistorySource)
    spark.read.format("git_history").option("path", "/repo").option("limit", 1000).load()
    spark.readStream.format("git_history").option("path", "/repo").load()
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .masking import mask_token

_FIELD, _RECORD = "\x1f", "\x1e"
#: Commits that git is asked for at once, and the most tasks that one read is cut into.
ROWS, TASKS = 500, 256
#: Pages of issues that one task asks for.
PAGES = 10
COMMIT = "repo_id int, id int, sha string, author_name string, author_email string, authored_at string, committer_name string, committed_at string, message string, insertions int, deletions int, files_changed int, parents array<string>, changes array<struct<path: string, change_type: string, insertions: int, deletions: int>>"
ISSUE = "json string, page int, place int"


def git(root: str, *args: str, given: str | None = None) -> str:
    done = subprocess.run(["git", "-C", root, *args], input=given, capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise RuntimeError(mask_token(done.stderr.strip(), None))
    return done.stdout


def _log(root: str, shas: list[str], form: str, what: str) -> list[str]:
    """git's records of these commits, in their order, with what changed against the first parent."""
    args = ("log", "--no-walk=unsorted", "--stdin", f"--format={_RECORD}{form}{_FIELD}", what, "--diff-merges=first-parent", "--root", "--no-renames")
    return git(root, *args, given="\n".join(shas)).split(_RECORD)[1:]


def commit_rows(root: str, repo_id: int, first: int, shas: list[str]) -> Iterator[tuple]:
    """The rows of these commits, numbered from `first`."""
    kinds: dict[tuple[str, str], str] = {}
    for record in _log(root, shas, "%H", "--name-status"):
        sha, _, body = record.partition(_FIELD)
        for line in body.strip().splitlines():
            kind, _, path = line.partition("\t")
            kinds[sha, path] = kind[:1] or "M"
    form = _FIELD.join(("%H", "%an", "%ae", "%aI", "%cn", "%cI", "%P", "%B"))
    for number, record in enumerate(_log(root, shas, form, "--numstat"), first):
        sha, an, ae, at, cn, ct, parents, message, body = record.split(_FIELD, 8)
        changes = []
        for line in body.strip().splitlines():
            plus, minus, path = line.split("\t", 2)
            changes.append((path, kinds.get((sha, path), "M"), int(plus) if plus.isdigit() else 0, int(minus) if minus.isdigit() else 0))
        yield repo_id, number, sha, an, ae, at, cn, ct, message.rstrip("\n"), sum(c[2] for c in changes), sum(c[3] for c in changes), len(changes), parents.split(), changes


class CommitRange(InputPartition):
    """`count` commits after the first `skip` of those that git lists for `revisions`."""

    def __init__(self, revisions: tuple[str, ...], skip: int, count: int):
        super().__init__((revisions, skip, count))
        self.revisions, self.skip, self.count = revisions, skip, count


class _History:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("git_history needs the option path")
        self.path, self.repo_id = options["path"], int(options.get("repo_id", 1))
        self.limit = int(options["limit"]) if options.get("limit") is not None else None
        self.rows = int(options.get("rows", ROWS))

    def ranges(self, *revisions: str) -> list[CommitRange]:
        """Ranges of the commits that the revisions name; no commit itself is listed here."""
        cap = [f"--max-count={self.limit}"] if self.limit is not None else []
        n = int(git(self.path, "rev-list", "--count", *cap, *revisions))
        size = max(self.rows, -(-n // TASKS))
        return [CommitRange(revisions, a, min(size, n - a)) for a in range(0, n, size)]

    def read(self, part: CommitRange) -> Iterator[tuple]:
        shas = git(self.path, "rev-list", f"--skip={part.skip}", f"--max-count={part.count}", *part.revisions).split()
        for a in range(0, len(shas), self.rows):
            yield from commit_rows(self.path, self.repo_id, part.skip + a + 1, shas[a : a + self.rows])


class HistoryReader(_History, DataSourceReader):
    def partitions(self) -> list[CommitRange]:
        # the commit that HEAD is now, so that all tasks count along the same list; none in an empty repository
        head = git(self.path, "rev-list", "--max-count=1", "--all").strip() and git(self.path, "rev-parse", "HEAD").strip()
        # Spark asks a reader without partitions to read None
        return (self.ranges(head) if head else []) or [CommitRange((), 0, 0)]

    def read(self, part: CommitRange) -> Iterator[tuple]:
        return super().read(part) if part.count else iter(())


class HistoryStream(_History, DataSourceStreamReader):
    """Each batch holds the commits that came since the last one; the offset is the name of the newest."""

    def initialOffset(self) -> dict:
        return {"sha": ""}

    def latestOffset(self) -> dict:
        known = git(self.path, "rev-list", "--max-count=1", "--all").strip()
        return {"sha": git(self.path, "rev-parse", "HEAD").strip() if known else ""}

    def partitions(self, start: dict, end: dict) -> list[CommitRange]:
        if not end["sha"] or start == end:
            return []
        return self.ranges(end["sha"], *([f"^{start['sha']}"] if start["sha"] else []))

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class HistorySource(DataSource):
    """Commits of HEAD, the newest first, with their changes against the first parent.

    Options: path, which all executors can reach; repo_id; limit, the most commits of a read (all
    by default; a stream has none); rows, commits a task at least. `id` counts from 1, the newest; in
    a stream it counts within each batch. An empty repository has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return COMMIT

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)

    def streamReader(self, schema) -> HistoryStream:
        if self.options.get("limit") is not None:
            raise ValueError("a stream of commits has no limit: the rest of a batch would be lost")
        return HistoryStream(self.options)


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class PageReader(DataSourceReader):
    def __init__(self, get: Callable[[int], list[str]], options: dict):
        self.get, self.limit, self.size = get, int(options.get("limit", 500)), int(options.get("page_size", 100))

    def partitions(self) -> list[PageRange]:
        pages = -(-self.limit // self.size)
        return [PageRange(a, min(a + PAGES - 1, pages)) for a in range(1, pages + 1, PAGES)] or [PageRange(1, 0)]

    def read(self, part: PageRange) -> Iterator[tuple]:
        for page in range(part.first, part.last + 1):
            items = self.get(page)
            for place, item in enumerate(items[: self.limit - (page - 1) * self.size], 1):
                yield item, page, place
            if len(items) < self.size:
                return


def issue_source(get: Callable[[int], list[str]], name: str = "issue_pages") -> type[DataSource]:
    """A data source of the JSON texts that get(page) returns, pages from 1, the newest first.

    Options: limit (500) and page_size (100). `get` is sent to the tasks. A page shorter than page_size is
    the last one of its task; pages beyond the end are empty.
    """

    class IssueSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ISSUE

        def reader(self, schema) -> PageReader:
            return PageReader(get, self.options)

    return IssueSource
