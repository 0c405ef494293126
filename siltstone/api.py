"""What a server would answer: plain dictionaries, for any transport."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .engine import Engine
from .operators.crawl import CrawlOptions
from .operators.retrieval import SearchOptions


def answer(f: Callable[[], object]) -> dict:
    """{"success": true, "data": …} or {"success": false, "error": …}; empty fields are left out."""
    try:
        data = f()
    except (LookupError, RuntimeError, ValueError) as problem:
        return {"success": False, "error": str(problem)}
    return {"success": True} | ({} if data is None else {"data": data})


def rows(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]


class Api:
    """Handlers over an engine. Results are cut to a limit, so what reaches the driver is bounded."""

    def __init__(self, engine: Engine, source: Callable[[str], DataFrame]):
        """``source(url)`` gives the table of pages (url, html) that a crawl of ``url`` reads."""
        self.engine, self.source = engine, source

    def list_libraries(self) -> dict:
        def make():
            out: dict[str, dict] = {}
            for r in rows(self.engine.list_libraries()):
                lib = out.setdefault(r["library"], {"name": r["library"], "versions": []})
                if "version" in r:
                    lib["versions"].append({"name": r["version"], "status": r["status"], "page_count": r["page_count"]})
            return list(out.values())

        return answer(make)

    def get_library(self, name: str) -> dict:
        def make():
            found = [x for x in self.list_libraries()["data"] if x["name"] == name.lower()]
            if not found:
                raise LookupError(f"library {name!r} not found")
            return found[0]

        return answer(make)

    def _remove(self, name: str, version: str | None) -> None:
        if not self.engine.remove(name, version):
            raise LookupError(f"{name!r} not found" if version is None else f"version {version!r} of {name!r} not found")

    def delete_library(self, name: str) -> dict:
        return answer(lambda: self._remove(name, None))

    def delete_version(self, name: str, version: str) -> dict:
        """``_default_`` names the unversioned one."""
        return answer(lambda: self._remove(name, version))

    def search(self, name: str, query: str, limit: int = 5) -> dict:
        """In the newest version."""
        return answer(lambda: rows(self.engine.search_latest(name, query, options=SearchOptions(limit=limit))))

    def create_job(self, library: str, url: str, version: str = "", max_pages: int = 1000, max_depth: int = 3) -> dict:
        return answer(lambda: self._job(self.engine.scrape(library, version, self.source(url), url, CrawlOptions(max_pages, max_depth))))

    @staticmethod
    def _job(job) -> dict:
        return {k: v for k, v in vars(job).items() if k != "cancel" and v is not None}

    def list_jobs(self, status: str | None = None) -> dict:
        jobs = self.engine.manager.jobs.values()
        return answer(lambda: [self._job(j) for j in sorted(jobs, key=lambda j: j.created_at) if status in (None, j.status)])

    def cancel_job(self, job_id: str) -> dict:
        return answer(lambda: {"cancelled": self.engine.manager.cancel(job_id)})

    def clear_jobs(self) -> dict:
        return answer(lambda: {"removed": self.engine.manager.clear_completed()})

    # The same as tools for an assistant: text in, text out.

    def tool_scrape_docs(self, library: str, url: str, version: str = "", max_pages: int = 1000, max_depth: int = 10) -> str:
        job = self.engine.scrape(library, version, self.source(url), url, CrawlOptions(max_pages, max_depth))
        self.engine.manager.wait(job.id)
        docs, pages = self.engine.store.read("documents"), self.engine.store.read("pages")
        vid = self.engine.ensure_version(library, version)
        mine = pages.filter(pages["version_id"] == vid).withColumnRenamed("id", "page_id").select("page_id")
        return f"Indexed {mine.count()} pages, {docs.join(mine, 'page_id', 'left_semi').count()} chunks of {library.lower()}."

    def tool_search_docs(self, library: str, query: str, version: str | None = None, limit: int = 10) -> str:
        return self.engine.search_text(library, query, version=version, options=SearchOptions(limit=limit))

    def tool_list_libraries(self) -> str:
        found = self.list_libraries()["data"]
        lines = [f"- {x['name']}: {', '.join(v['name'] or 'unversioned' for v in x['versions']) or 'none'}" for x in found]
        return "\n".join(lines) or "No libraries."

    def tool_remove_library(self, library: str) -> str:
        return f"Removed {library}." if self.engine.remove(library) else f"{library} not found."
