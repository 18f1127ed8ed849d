"""The application's parameter contracts as functions: each checks its parameters and gives a DataFrame.

Routes, tools and their defaults: pairs and graphs by kind, pages of 1 to 500 (references to 200), matches of 1 to 18.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import affinity, composites, graph, relational, vectors
from lodestar.operators.helpers import page, paged
from lodestar.sources import markdown, state
from lodestar.sources.roles import Roles


class NotFound(LookupError):
    pass


def _limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    return limit


class Api:
    def __init__(self, roles: Roles):
        self.r = roles

    # reports
    def coverage(self) -> DataFrame:
        return relational.coverage(self.r.projects, self.r.runs, self.r.targets)

    def groups(self) -> DataFrame:
        return relational.projects_per_group(self.r.groups, self.r.project_groups)

    def funding(self, spellings: dict[str, str] | None = None) -> DataFrame:
        """Spellings of one funder, the fixed ones unless others are given, count as one."""
        return relational.funding_breakdown(self.r.projects, dict.fromkeys(relational.FCT_SPELLINGS, "FCT") if spellings is None else spellings)

    def budget_by_group(self) -> DataFrame:
        return relational.budget_by_group(self.r.projects, self.r.groups, self.r.project_groups)

    def budget_by_year(self) -> DataFrame:
        return relational.budget_by_year(self.r.projects)

    def timeline(self) -> DataFrame:
        return relational.start_timeline(self.r.projects)

    def coordinators(self) -> DataFrame:
        return relational.top_coordinators(self.r.project_people, self.r.people, self.r.aliases, self.r.project_groups)

    def partners(self) -> DataFrame:
        return relational.partners_breakdown(self.r.partners)

    def top_projects(self, code: str | None = None) -> DataFrame:
        if code is not None and not self.r.groups.where(F.col("code") == code).limit(1).count():
            raise NotFound(code)
        return relational.top_projects_per_group(self.r.projects, self.r.groups, self.r.project_groups, code=code)

    def projects(self, group: str | None = None, q: str | None = None, detail_unavailable: bool | None = None, limit: int = 50, offset: int = 0, total: bool = False) -> DataFrame:
        """total: with the number of all projects found, in a column."""
        return relational.projects_page(self.r.projects, self.r.project_groups, group, q, detail_unavailable, _limit(limit, 500), offset, total)

    def project(self, project_id: int) -> DataFrame:
        """The project with its groups, people, partners and raw fields."""
        r = self.r
        return composites.project_detail(project_id, r.projects, r.project_groups, r.groups, r.project_people, r.people, r.partners, r.fields)

    # theses
    def theses(self) -> DataFrame:
        return composites.list_theses(self.r.theses, self.r.thesis_people, self.r.people)

    def thesis(self, handle, corpus: str | None = None) -> DataFrame:
        """The thesis with abstracts and, where a corpus folder is named, its body."""
        bodies = markdown.read_bodies(self.r.spark, corpus, [str(handle)]).withColumn("handle", F.lit(handle)) if corpus else None
        return composites.thesis_detail(handle, self.r.theses, self.r.thesis_people, self.r.people, bodies=bodies)

    def thesis_body(self, handle, corpus: str) -> DataFrame:
        return markdown.read_bodies(self.r.spark, corpus, [str(handle)])

    def thesis_authors(self) -> DataFrame:
        """What the author filter offers."""
        return composites.author_options(self.theses())

    def bibliography_theses(self) -> DataFrame:
        return relational.references_per_thesis(self.r.theses, self.r.citations)

    def partner_theses(self) -> DataFrame:
        return relational.partner_thesis_links(self.r.partners, self.r.projects, self.r.project_people, self.r.people, self.r.thesis_people, self.r.theses)

    def list_theses(self, year: str | None = None, limit: int = 50, group: str | None = None, content: DataFrame | None = None, total: bool = False) -> DataFrame:
        """Theses with their groups and tier. content (handle, group_code, content_share): the signal of the texts, where it has
        been worked out; total: with the number of all theses found, in a column."""
        r = self.r
        people = affinity.people_signal(r.thesis_people, relational.person_group_shares(r.project_people, r.project_groups))
        agreed = affinity.agreement(r.theses, people, people.limit(0).withColumnRenamed("people_share", "content_share") if content is None else content)
        return (paged if total else page)(composites.theses_of_group(r.theses, agreed, year, group), [F.asc("handle")], _limit(limit, 500))

    def identity_coverage(self) -> DataFrame:
        r = self.r
        return composites.identity_coverage(relational.match_tiers(r.thesis_people), relational.attribution_coverage(r.thesis_people, r.listings, r.theses))

    def person_keywords(self, slug, keywords: DataFrame, theses: bool = False) -> DataFrame:
        """Keywords (of projects; theses: of theses) that a person took part in, the commonest first."""
        r, key = self.r, "handle" if theses else "project_id"
        members = r.thesis_people.where("match_status in ('exact', 'confident')") if theses else r.project_people
        return relational.person_keywords(keywords, members, r.aliases, [slug], key).orderBy(F.desc("n"), "keyword")

    # collaboration
    def edges(self, kind: str = "co_project") -> DataFrame:
        if kind == "co_project":
            return graph.co_project_edges(self.r.project_people, self.r.aliases)
        if kind == "co_supervision":
            return graph.co_supervision_edges(self.r.thesis_people, self.r.aliases)
        raise ValueError(f"kind {kind}")

    def collab_summary(self, kind: str = "co_project") -> DataFrame:
        return graph.summary(self.edges(kind), graph.FLOORS[kind])

    def collab_pairs(self, kind: str = "co_project", min_weight: int | None = None, sort: str = "weight", limit: int = 50, offset: int = 0, total: bool = False) -> DataFrame:
        if sort not in ("weight", "normalized"):
            raise ValueError(f"sort {sort}")
        return graph.ranked_pairs(self.edges(kind), graph.FLOORS[kind] if min_weight is None else min_weight, sort, _limit(limit, 500), offset, total)

    def collab_graph(self, kind: str = "co_project", min_weight: int | None = None) -> tuple[DataFrame, DataFrame]:
        floor, e = graph.GRAPH_FLOORS[kind] if min_weight is None else min_weight, self.edges(kind)
        return graph.graph_nodes(e, floor), graph.graph_edges(e, floor)

    def collab_people(self, q: str | None = None, limit: int = 20) -> DataFrame:
        return relational.people_search(self.r.people, self.r.project_people, self.r.aliases, q, _limit(limit, 500))

    def collab_person(self, slug) -> DataFrame:
        return graph.neighbours(self.edges(), self.edges("co_supervision"), slug)

    def person(self, slug) -> DataFrame:
        r = self.r
        return composites.person_detail(slug, r.people, r.aliases, r.project_people, r.projects, r.project_groups, r.thesis_people)

    # references, search, health
    def bibliography(self, min_cited_by: int = 2, q: str | None = None, tier: str | None = None, limit: int = 50, offset: int = 0, total: bool = False) -> DataFrame:
        return relational.references_page(self.r.references, min_cited_by, q, tier, _limit(limit, 200), offset, total)

    def bibliography_summary(self) -> DataFrame:
        return relational.bibliography_summary(self.r.references, self.r.citations, self.r.theses)

    def reference(self, reference_id: int) -> DataFrame:
        """A work with the theses that cite it."""
        cites = self.r.citations.where(F.col("reference_id") == reference_id).groupBy("reference_id").agg(F.array_sort(F.collect_set("handle")).alias("cited_in"))
        return self.r.references.join(cites, "reference_id")

    def search(self, vector: list[float], k: int = 5, floor: float | None = None) -> DataFrame:
        found = vectors.nearest(self.r.passages, [vector], _limit(k, 100))
        return found if floor is None else vectors.relevant(found, floor)

    def fit(self, facets: list[list[float]], k: int = 8) -> DataFrame:
        return vectors.multi_facet(self.r.passages, facets, k)

    def store_state(self) -> DataFrame:
        """name, state and reason of the tables that search needs; never fails."""
        at = self.r.sf_dir
        return state.store_states(self.r.spark, {"passages": (f"{at}/embeddings.parquet", ["vec_id", "label", "embedding"]), "theses": (f"{at}/documents.parquet", ["doc_id", "text"])})

    def index_status(self) -> DataFrame:
        return vectors.vector_coverage(self.r.passages)

    def healthz(self) -> DataFrame:
        return relational.table_counts({"projects": self.r.projects, "people": self.r.people, "theses": self.r.theses, "references": self.r.references})
