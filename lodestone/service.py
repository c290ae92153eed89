"""Several repositories behind one service: which is active, jobs, findings and conversations as state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import engine, providers
from .engine import Repository
from .functions import paths as P
from .lineage import cut, new_folder
from .operators import findings, mining
from .operators.retrieval import Embedder
from .sources import repository, sinks
from .sources.snapshots import SnapshotTable

# How many conversations a list shows, and their kinds.
LISTED = 40
KINDS = ("investigate", "codemap")
FINDING = "id long, file_path string, start_line long, end_line long, category string, severity string, title string, description string, suggested_fix string, status string, jira_url string, head_sha string"
#: The service's own tables: their columns, and the column whose values are kept apart.
STATE = {
    "repos": ("id long, url string, name string, default_branch string, head_sha string", None),
    "jobs": ("id string, kind string, target string, status string, step string, error string, result string, started timestamp", None),
    "findings": (FINDING + ", repo_id long", "repo_id"),
    "conversations": ("id long, repo_id long, kind string, question string, result string, created_at timestamp", "repo_id"),
}


class Refused(Exception):
    """What a request can't have: 404 for what is not there, 409 for what may not change, 422 for what makes no sense, 400 for what is not set up."""

    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


@dataclass
class Job:
    kind: str
    target: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    status: str = "queued"
    step: str = ""
    error: str | None = None
    result: dict = field(default_factory=dict)
    started: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


class Service:
    """Ingests repositories into `folder` and answers for the one ingested last.

    What it knows (repositories with their tables, jobs, findings, conversations) is in snapshot tables
    below `state`, a folder that driver and executors share: a service that is started there later knows
    it too, and jobs that had not ended are then in error. One service at a time writes there. Without
    `state` a new folder below the shared one is taken.

    open_: (url, token) to the local path of a working tree; run: what starts a job's work, at once by
    default. tracker: makes a ticket of a payload and returns its address. model: what answers prompts;
    or models: name to call, of which the first in the usual order (or `preferred`) is taken, tried again
    when it fails, and its calls kept as rows. embedder: what makes vectors of texts, for searches by them.
    """

    def __init__(self, spark: SparkSession, folder: str, *, state: str | None = None, open_: Callable[[str, str | None], str] | None = None, run: Callable[[Callable[[], None]], None] | None = None, tracker: Callable[[str], str] | None = None, model: Callable[[str], str] | None = None, models: dict[str, Callable[[str], str] | None] | None = None, preferred: str | None = None, embedder: Embedder | None = None):
        self.embedder = embedder
        self.spark, self.tracker, self.calls = spark, tracker, providers.Calls()
        chosen = ("model", model) if model else providers.resolve(models or {}, preferred)
        self.model = self.calls.watched(chosen[0], providers.retrying(chosen[1]) if model is None else model) if chosen else None
        self.open = open_ or (lambda url, token: repository.clone_or_open(url, folder, token))
        self.run = run or (lambda work: work())
        self.state = (state or new_folder(spark, "service")).rstrip("/")
        self.tables = {name: SnapshotTable(spark, f"{self.state}/{name}", by) for name, (_, by) in STATE.items()}
        for name, table in self.tables.items():
            if not table.exists():
                table.replace(spark.createDataFrame([], STATE[name][0]))
        open_jobs = F.col("status").isin("queued", "running")
        if not self.tables["jobs"].read().where(open_jobs).isEmpty():
            ended = F.when(open_jobs, "error").otherwise(F.col("status"))
            error = F.when(open_jobs, "The service ended before the job did.").otherwise(F.col("error"))
            self.tables["jobs"].update(lambda jobs: jobs.withColumn("error", error).withColumn("status", ended))
        self.kept: dict[int, Repository] = {}

    def _repository(self, info: dict) -> Repository:
        if info["id"] not in self.kept:
            self.kept[info["id"]] = Repository.load(self.spark, self.state, info, self.model)
            self.kept[info["id"]].embedder = self.embedder
        return self.kept[info["id"]]

    def active(self) -> Repository:
        row = mining.latest_repo(self.tables["repos"].read()).first()
        if row is None:
            raise Refused(404, "No repository has been ingested yet.")
        return self._repository(row.asDict())

    def repos(self) -> list[dict]:
        """Every repository, the newest first."""
        return [{**r.asDict(), "counts": self._repository(r.asDict()).status()["counts"]} for r in self.tables["repos"].read().orderBy(F.desc("id")).collect()]

    def telemetry(self) -> DataFrame:
        """Calls of the model, their total and mean seconds, by name."""
        return sinks.telemetry(self.calls.table(self.spark))

    def normalised(self, url: str) -> str:
        parts = urlsplit(url.strip())
        if parts.scheme not in ("http", "https") or not parts.netloc:
            raise Refused(422, "A repository needs a full http or https address.")
        return self.spark.range(1).select(P.normalise_repo_url(F.lit(url.strip())).alias("u")).first()["u"]

    def _save(self, job: Job) -> None:
        row = (job.id, job.kind, job.target, job.status, job.step, job.error, json.dumps(job.result), job.started)
        self.tables["jobs"].merge(self.spark.createDataFrame([row], STATE["jobs"][0]), ["id"])

    def _start(self, job: Job, work: Callable[[Job], None], token: str | None = None) -> dict:
        self._save(job)

        def whole() -> None:
            job.status = "running"
            self._save(job)
            try:
                work(job)
                job.status = "done"
            except Exception as e:
                job.status, job.error = "error", repository.mask_token(str(e), token)
            self._save(job)

        self.run(whole)
        return {"job_id": job.id, "status": job.status}

    def add(self, url: str, token: str | None = None) -> dict:
        """Ingest a repository as a job; one that runs already for this address is returned instead."""
        address = self.normalised(url)
        same = self.tables["jobs"].read().where((F.col("kind") == "ingest") & (F.col("target") == address) & F.col("status").isin("queued", "running"))
        running = same.orderBy("started").first()
        if running is not None:
            return {"job_id": running["id"], "status": running["status"], "repo_url": address}

        def work(job: Job) -> None:
            job.step = "clone"
            self._save(job)
            path = self.open(address, token)
            job.step = "ingest"
            self._save(job)
            repos = self.tables["repos"]
            number = (repos.read().agg(F.max("id")).first()[0] or 0) + 1
            known = repos.read().where(F.col("url") == address).orderBy(F.desc("id")).first()
            if known is None:
                made = Repository.ingest(self.spark, path, url=address, repo_id=number, model=self.model)
            else:
                made = self._repository(known.asDict()).refreshed(path, repo_id=number)
            made.store(self.state)
            new = self.spark.createDataFrame([tuple(made.info[c] for c in ("id", "url", "name", "default_branch", "head_sha"))], STATE["repos"][0])
            old = [r["id"] for r in repos.read().where(F.col("url") == address).collect()]
            # the repository is there, whole, from this commit on; only then do the tables of the one before go
            repos.update(lambda rows: rows.where(F.col("url") != address).unionByName(new), kind="ingest")
            for repo_id in old:
                self.kept.pop(repo_id, None)
                for name in engine.TABLES:
                    sinks.delete_repository(self.spark, f"{self.state}/{name}", repo_id)
            job.result = {"repo_id": number}

        return {**self._start(Job("ingest", address), work, token), "repo_url": address}

    def refresh(self, token: str | None = None) -> dict:
        """The active repository as its tree is now; files that did not change are not parsed again."""
        return self.add(self.active().info["url"], token)

    def job(self, job_id: str) -> dict:
        row = self.tables["jobs"].read().where(F.col("id") == job_id).first()
        if row is None:
            raise Refused(404, f"There is no job {job_id}.")
        return {**row.asDict(), "result": json.loads(row["result"])}

    def health(self, checks: dict[str, Callable[[], object]] | None = None) -> dict:
        """Whether Spark, the shared folder's file system and other dependencies answer."""
        every = {"spark": lambda: self.spark.range(1).count(), **(checks or {})}
        out = {}
        for name, check in every.items():
            try:
                check()
                out[name] = {"status": "ok"}
            except Exception as e:
                out[name] = {"status": "error", "detail": str(e)}
        return {"status": "ok" if all(c["status"] == "ok" for c in out.values()) else "degraded", "checks": out}

    # findings

    def _table(self, repo: Repository) -> DataFrame:
        return self.tables["findings"].read(values=[repo.info["id"]])

    def scan(self, scan_all: bool = False) -> dict:
        """Look for findings as a job; ticketed ones stay, all others are replaced."""
        repo = self.active()

        def work(job: Job) -> None:
            found, notes = repo.scan(scan_all)
            found = cut(found)  # numbered as they are now, however often the change is worked out

            def change(old: DataFrame) -> DataFrame:
                number = old.agg(F.max("id")).first()[0] or 0
                place = F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path", "start_line", "title"))
                own = {"id": place.cast("long") + number, "status": F.lit("new"), "jira_url": F.lit(None).cast("string"), "head_sha": F.lit(repo.info["head_sha"])}
                return findings.replace_findings(old, found.withColumns(own).select(*old.columns))

            self.tables["findings"].update(change, [repo.info["id"]], "scan")
            job.result = {"found": found.count(), "notes": notes}

        return self._start(Job("scan", repo.info["url"]), work)

    def weaknesses(self) -> dict:
        """All findings of the active repository in their order, with language and lines."""
        repo = self.active()
        rows = findings.listed(findings.with_files(self._table(repo), repo.files.select("repo_id", "path", "content"))).orderBy("place")
        return {"repo": repo.info["name"], "head_sha": repo.info["head_sha"], "weaknesses": [{k: v for k, v in r.asDict().items() if k not in ("repo_id", "place", "severity_rank")} for r in rows.collect()]}

    def dismiss(self, finding_id: int) -> dict:
        repo = self.active()
        refusal = findings.refusal(self._table(repo), finding_id)
        if refusal:
            raise Refused(refusal, "There is no such finding." if refusal == 404 else "The finding has a ticket and can't be dismissed.")
        ids = self.spark.createDataFrame([(finding_id,)], "id long")
        self.tables["findings"].update(lambda rows: findings.set_status(rows, ids, "dismissed"), [repo.info["id"]], "dismiss")
        return {"id": finding_id, "status": "dismissed"}

    def tickets(self, ids: list[int], project: str = "") -> dict:
        """Make tickets of findings as a job; one that has a ticket keeps it."""
        repo = self.active()
        if self.tracker is None:
            raise Refused(400, "No tracker is configured.")
        if not ids:
            raise Refused(422, "Select at least one finding.")

        def work(job: Job) -> None:
            chosen = self._table(repo).where(F.col("id").isin(ids) & (F.col("status") != "ticketed"))
            made = [(r["id"], self.tracker(r["payload"])) for r in sinks.ticket_payloads(chosen, project).collect()]
            tickets = self.spark.createDataFrame(made, "id long, jira_url string")
            self.tables["findings"].update(lambda rows: findings.ticketed(rows, tickets), [repo.info["id"]], "ticket")
            job.result = {"created": len(made), "skipped": len(set(ids)) - len(made)}

        return self._start(Job("tickets", repo.info["url"]), work)

    # conversations

    def save_conversation(self, kind: str, question: str, result: dict) -> int:
        if kind not in KINDS:
            raise Refused(422, f"A conversation is one of {', '.join(KINDS)}.")
        table, repo_id = self.tables["conversations"], self.active().info["id"]
        number = (table.read().agg(F.max("id")).first()[0] or 0) + 1
        row = (number, repo_id, kind, question.strip(), json.dumps(result, default=str), datetime.now(timezone.utc))
        table.append(self.spark.createDataFrame([row], STATE["conversations"][0]))
        return number

    def conversations(self, kind: str, limit: int = LISTED) -> list[dict]:
        """The active repository's conversations of a kind, the newest first."""
        own = self.tables["conversations"].read(values=[self.active().info["id"]]).where(F.col("kind") == kind)
        return [{**r.asDict(), "created_at": r["created_at"].isoformat()} for r in own.orderBy(F.desc("id")).limit(limit).select("id", "question", "created_at").collect()]

    def conversation(self, number: int) -> dict:
        row = self.tables["conversations"].read().where(F.col("id") == number).first()
        if row is None:
            raise Refused(404, "There is no such conversation.")
        return {**{k: row[k] for k in ("id", "kind", "question")}, "result": json.loads(row["result"]), "created_at": row["created_at"].isoformat()}

    def delete_conversation(self, number: int) -> dict:
        self.conversation(number)
        self.tables["conversations"].delete(f"id = {int(number)}")
        return {"deleted": number}

    def investigate(self, question: str) -> dict:
        """The active repository's answer, kept as a conversation."""
        answer = self.active().investigate(question)
        return {**answer, "conversation_id": self.save_conversation("investigate", question, answer)}

    def codemap(self, question: str) -> dict:
        """The active repository's code map for a question, kept as a conversation."""
        answer = self.active().codemap(question)
        return {**answer, "conversation_id": self.save_conversation("codemap", question, answer)}

    # pages

    def publish(self, pages: dict[str, dict], find: Callable[[str], str | None], create: Callable[[str, str], str], update: Callable[[str, str], None], attach: Callable[[str, str, bytes], None] | None = None) -> dict:
        """Pages by title, made or changed, with their attachments, as a job.

        pages: title to {"body", "attachments"}; find gives a page's id by title, create makes one.
        """

        def work(job: Job) -> None:
            done = {"created": [], "updated": []}
            for title, page in pages.items():
                known = find(title)
                if known is None:
                    known = create(title, page["body"])
                    done["created"].append(title)
                else:
                    update(known, page["body"])
                    done["updated"].append(title)
                for name, data in (page.get("attachments") or {}).items():
                    if attach is not None:
                        attach(known, name, data)
            job.result = done

        return self._start(Job("publish", self.active().info["url"]), work)
