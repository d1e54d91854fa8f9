"""Every operator bound to the supplied tables, each with an independent SQL statement of the result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import archives as A
from ..operators import changes as C
from ..operators import closure as K
from ..operators import deps as D
from ..operators import history as H
from ..operators import naming as N
from ..operators import oplog as L
from ..operators import selection as S
from ..operators.grouping import order_in_group
from ..operators.reachability import CommitIndex
from ..session import application_path, configure, scratch_path
from ..sources import tables
from ..sources.state_table import StateTable
from ..sources.updates import UpdateTable
from ..streaming import jobs as J
from .bindings import Source, standalone_sql

AS_OF = datetime(1999, 1, 1)

_QUERIES: dict[str, Callable[[Source], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Source], DataFrame]):
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = oracle
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build):
        return lambda spark, folder: build(Source(configure(spark), folder))

    return {name: bound(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: standalone_sql(text) for name, text in _ORACLES.items()}


# Shared pieces of the expected results.
_ERROR_CASE = """case when length({n}) > 100 then 'Name exceeds 100 characters: ' || cast(length({n}) as varchar)
    when {n} in ('.', '..') then 'Name cannot be ''.'' or ''..'''
    when {n} like '%.git' then 'Name cannot end with .git'
    when substr({n}, 1, 1) in ('-', '_', '.') then 'Name cannot start with hyphen, underscore, or period'
    when not regexp_full_match({n}, '[a-zA-Z0-9._-]+') then 'Name contains invalid characters (only alphanumeric, -, _, . allowed)' end"""


def _error_case(column: str) -> str:
    return _ERROR_CASE.replace("{n}", column)


def _mean(column: str) -> str:
    return f"cast(sum(cast({column} as decimal(18,4))) as double) / count({column})"


# === A: scan and selection ===============================================================


@query("subtree_all", "select id, path from {v_repos} where path like 'ASIA/%'")
def _(s):
    return S.subtree(s["v_repos"], "ASIA").select("id", "path")


@query(
    "subtree_direct",
    "select id, path from {v_repos} where path like 'ASIA/NATION\\_2/%' escape '\\' and len(string_split(path, '/')) = 3",
)
def _(s):
    return S.subtree(s["v_repos"], "ASIA/NATION_2", direct_only=True).select("id", "path")


@query(
    "project_details",
    """select r.id, r.path, d.id is not null as has_details, case when d.id is not null then coalesce(d.description, '') end as description,
    case when d.id is not null then coalesce(d.topic_text, '') end as topics,
    case when d.id is not null then coalesce(d.visibility, 'private') end as visibility,
    case when d.id is not null then coalesce(d.default_branch, 'main') end as default_branch
    from {v_repos} r left join {v_details} d on r.id = d.id""",
)
def _(s):
    details = _details(s)
    return S.project_details(s["v_repos"].select("id", "path"), details).withColumn("topics", F.array_join("topics", ","))


def _details(s: Source) -> DataFrame:
    return s["v_details"].withColumn("topics", F.split("topic_text", ",")).drop("topic_text")


@query(
    "exclude_filter",
    """select id, path from {v_paths} where not (path like 'small/%' or path like '%/old-%' or path like '%bolt'
    or path = 'economy/Brand-2/small-ring') and path not in (select 'promo/' || replace(p_brand, '#', '-') || '/hot-gear' from {part})""",
)
def _(s):
    exact = s["part"].select(F.concat(F.lit("promo/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/hot-gear")).alias("path"))
    return S.exclude_filter(s["v_paths"], "path", ["small/*", "*/old-*", "*bolt", "economy/Brand-2/small-ring"], exact)


@query(
    "exclude_by_group",
    """select id, path from {v_repos} r where not exists (select 1 from {nation} n join {region} g on g.r_regionkey = n.n_regionkey
    where n.n_name = split_part(r.path, '/', 2) and n.n_nationkey % 2 = 0 and r.path like g.r_name || '/%'
    and r.path like '%' || cast(n.n_nationkey % 10 as varchar))
    and not (r.segment = 'BUILDING' and 'NATION_' || (r.id % 25) = split_part(r.path, '/', 2))""",
)
def _(s):
    projects = s["v_repos"].select("id", "path", F.split("path", "/")[1].alias("group_name"))
    return S.exclude_by_group(projects, s["v_excludes"]).drop("group_name")


@query(
    "config_overrides",
    """select id, path, coalesce(g.clone_depth, 0) as clone_depth, coalesce(g.lfs_enabled, false) as lfs_enabled,
    coalesce(g.sync_strategy, 'mirror') as sync_strategy
    from {v_repos} r left join {v_group_config} g on split_part(r.path, '/', 2) = g.group_name""",
)
def _(s):
    projects = s["v_repos"].select("id", "path", F.split("path", "/")[1].alias("group_name"))
    defaults = {"clone_depth": 0, "lfs_enabled": False, "sync_strategy": "mirror"}
    return S.config_overrides(projects, s["v_group_config"], ["group_name"], defaults).drop("group_name")


_LONGEST = """(select r.id, r.path, max_by(m.prefix, length(m.prefix)) as prefix, max_by(m.value, length(m.prefix)) as value
    from {v_repos} r left join {v_group_map} m on r.path = m.prefix or starts_with(r.path, m.prefix || '/') group by r.id, r.path)"""


@query("org_routing", f"select id, path, coalesce(value, 'org-default') as target_org from {_LONGEST} t")
def _(s):
    return S.org_routing(s["v_repos"].select("id", "path"), s["v_group_map"], "org-default")


@query(
    "platform_counts",
    """select platform, count(*) as n_urls from (select case when url like 'git@%' then 'ssh' when h = 'github.com' or h like '%.github.com' then 'github'
    when h like '%gitlab%' then 'gitlab' else 'unsupported' end as platform from
    (select url, lower(split_part(split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1), '#', 1)) as h from {v_remotes}) a) b group by platform""",
)
def _(s):
    return S.platform_counts(s["v_remotes"])


# === B: naming and planning ==============================================================


@query("map_flatten", "select id, path, replace(substr(path, strpos(path, '/') + 1), '/', '_') as target_name from {v_repos}")
def _(s):
    return N.map_names(s["v_repos"].select("id", "path"), "flatten", "_", strip_root=True, keep_last=5)


@query("map_prefix", "select id, path, split_part(path, '/', 2) || '-' || split_part(path, '/', 3) as target_name from {v_paths}")
def _(s):
    return N.map_names(s["v_paths"], "prefix", keep_last=2)


@query("map_full_path", "select id, path, replace(path, '/', '_') as target_name from {v_repos}")
def _(s):
    return N.map_names(s["v_repos"].select("id", "path"), "full_path", "_", strip_root=True)


@query(
    "map_custom",
    f"""select id, path, case when prefix is null then split_part(path, '/', -1) when prefix = path then value
    else value || '-' || replace(substr(path, length(prefix) + 2), '/', '-') end as target_name from {_LONGEST} t""",
)
def _(s):
    return N.map_names(s["v_repos"].select("id", "path"), "custom", custom=s["v_group_map"], fallback="prefix")


@query(
    "path_topics",
    "select id, path, lower(split_part(path, '/', 2)) as topics from {v_repos}",
)
def _(s):
    return s["v_repos"].select("id", "path", F.array_join(P.path_topics(F.col("path"), strip_root=True), ",").alias("topics"))


@query(
    "topic_counts",
    """select topic, count(*) as n_projects from (select lower(split_part(path, '/', 1)) as topic from {v_paths}
    union all select lower(split_part(path, '/', 2)) from {v_paths}) t group by topic""",
)
def _(s):
    return N.topic_counts(s["v_paths"])


@query("name_validity", f"select id, target_name, {_error_case('target_name')} is null as valid, {_error_case('target_name')} as error from {{v_names}}")
def _(s):
    return N.name_validity(s["v_names"])


@query(
    "name_conflicts",
    """select target_name, path, n_paths from (select split_part(path, '/', -1) as target_name, path,
    count(*) over (partition by split_part(path, '/', -1)) as n_paths from {v_paths}) t where n_paths > 1""",
)
def _(s):
    return N.name_conflicts(N.map_names(s["v_paths"], "prefix"))


@query(
    "map_flatten_normalised",
    "select id, replace(path, '/', '-') as target_name from {v_paths} join {part} on p_partkey = id where p_size not between 10 and 19",
)
def _(s):
    return N.map_normalised(s["v_messy_paths"]).select("id", "target_name")


@query(
    "blank_paths",
    "select p_partkey as id, case when p_size < 15 then 'path is empty' else 'path is null' end as reject_reason from {part} where p_size between 10 and 19",
)
def _(s):
    return N.blank_paths(s["v_messy_paths"]).select("id", "reject_reason")


@query(
    "map_prefix_label",
    "select id, 'infra-' || split_part(path, '/', 3) as target_name from {v_paths} join {part} on p_partkey = id where p_size not between 10 and 19",
)
def _(s):
    return N.map_labelled(s["v_messy_paths"], "infra").select("id", "target_name")


@query(
    "target_settings",
    """select d.id, split_part(r.path, '/', 3) as name, coalesce(description, '') as description, coalesce(topic_text, '') as topics,
    coalesce(visibility, 'private') in ('private', 'internal') as private, coalesce(default_branch, 'main') as default_branch
    from {v_details} d join {v_repos} r on r.id = d.id""",
)
def _(s):
    detailed = S.project_details(s["v_repos"].select("id", "path"), _details(s)).where("has_details")
    return N.target_settings(detailed).withColumn("topics", F.array_join("topics", ","))


def _planned(s: Source) -> DataFrame:
    named = N.map_names(s["v_repos"].select("id", "path"))
    return named.select("id", F.concat(F.lit("acme/"), "target_name").alias("full_name"))


@query("missing_targets", "select id, 'acme/' || replace(path, '/', '-') as full_name from {v_repos} where 'acme/' || replace(path, '/', '-') not in (select full_name from {v_targets})")
def _(s):
    return N.missing_targets(_planned(s), s["v_targets"]).select("id", "full_name")


@query("present_targets", "select id, 'acme/' || replace(path, '/', '-') as full_name from {v_repos} where 'acme/' || replace(path, '/', '-') in (select full_name from {v_targets})")
def _(s):
    return N.present_targets(_planned(s), s["v_targets"]).select("id", "full_name")


def migration_plan(s: Source) -> DataFrame:
    plan = N.migration_plan(
        s["v_repos"].select("id", "path", "web_url"), s["v_targets"], _details(s).drop("topics"),
        org="acme", base_url="https://hub.example.org", strategy="flatten", separator="-",
    )
    return plan.withColumn("path_topics", F.array_join("path_topics", ","))


_PLAN = f"""(select *, count(*) over (partition by target_name, valid) as same from (select *, error is null as valid from (
    select *, {_error_case('target_name')} as error from (select *, replace(path, '/', '-') as target_name from {{v_repos}}) a) b) c)"""


@query(
    "migration_plan",
    f"""select p.id, p.path, p.web_url as source_url, p.target_name, p.valid, p.error,
    case when p.valid then 'acme/' || p.target_name end as full_name,
    case when p.valid then 'https://hub.example.org/acme/' || p.target_name || '.git' end as target_url,
    lower(split_part(p.path, '/', 1)) || ',' || lower(split_part(p.path, '/', 2)) as path_topics,
    case when p.valid then p.same end as n_same_name,
    case when p.valid then t.full_name is not null end as target_exists,
    case when p.valid and d.id is not null then coalesce(d.description, '') end as description,
    case when p.valid and d.id is not null then coalesce(d.visibility, 'private') end as visibility,
    case when p.valid and d.id is not null then coalesce(d.default_branch, 'main') end as default_branch
    from {_PLAN} p left join {{v_targets}} t on t.full_name = 'acme/' || p.target_name left join {{v_details}} d on d.id = p.id""",
)
def _(s):
    return migration_plan(s)


@query(
    "plan_summary",
    f"""select count(*) as total_repos, count(*) filter (where error is null) as mapped_repos, count(*) filter (where error is not null) as skipped_repos,
    count(distinct target_name) filter (where error is null and n > 1) as conflicting_names,
    cast(0 as bigint) as created_repos, cast(0 as bigint) as synced_repos, cast(0 as bigint) as failed_repos
    from (select *, count(*) over (partition by target_name) as n from (select target_name, {_error_case('target_name')} as error from (
    select split_part(path, '/', 3) as target_name from {{v_paths}} union all select split_part(path, '/', 1) from {{v_repos}}) a) b) c""",
)
def _(s):
    paths = s["v_paths"].select("id", "path").unionByName(
        s["v_repos"].select(F.col("id") + 1_000_000_000_000, F.split("path", "/")[0].alias("path")).toDF("id", "path")
    )
    plan = N.migration_plan(
        paths.withColumn("web_url", F.lit("")), s["v_targets"], _details(s).drop("topics"),
        org="acme", base_url="https://hub.example.org", strategy="prefix",
    )
    return N.plan_summary(plan)


# === C: state, refs and commits ==========================================================


@query(
    "latest_state",
    """select repo, ts, seq, last_commit, branch from (select *, row_number() over (partition by repo order by ts desc, seq desc) as rn
    from {v_state_log}) t where rn = 1""",
)
def _(s):
    return C.latest_state(s["v_state_log"])


@query(
    "state_merge",
    """select repo, ts, seq, last_commit, branch from (select *, row_number() over (partition by repo order by ts >= timestamp '2000-01-01 00:00:00' desc,
    ts desc, seq desc) as rn from {v_state_log}) t where rn = 1""",
)
def _(s):
    writes, cut = s["v_state_log"], F.lit("2000-01-01").cast("timestamp_ntz")
    snapshot = C.latest_state(writes.where(F.col("ts") < cut))
    return C.state_merge(snapshot, writes.where(F.col("ts") >= cut))


@query("tracked_repos", "select distinct repo from {v_state_log}")
def _(s):
    return C.tracked_repos(s["v_state_log"])


_BRANCHES = """(select coalesce(o.repo, n.repo) as repo, coalesce(o.branch, n.branch) as branch,
    case when o.repo is null then 'new' when n.repo is null then 'deleted' else 'kept' end as status
    from {v_branches_old} o full join {v_branches_new} n on o.repo = n.repo and o.branch = n.branch)"""


@query("branch_status", f"select repo, branch, status from {_BRANCHES} t")
def _(s):
    return C.branch_status(s["v_branches_old"], s["v_branches_new"])


@query(
    "branch_diff",
    f"""select repo, count(*) filter (where status = 'new') as new_branch_count, count(*) filter (where status = 'deleted') as deleted_branch_count,
    count(*) filter (where status = 'new') > 0 as has_new_branches, count(*) filter (where status = 'deleted') > 0 as has_deleted_branches
    from {_BRANCHES} t group by repo""",
)
def _(s):
    return C.branch_diff(s["v_branches_old"], s["v_branches_new"])


@query(
    "change_status",
    """select h.repo, h.head, st.last_commit, case when st.last_commit is null then 'first_sync' when st.last_commit = h.head then 'unchanged' else 'changed' end as status,
    st.last_commit is null or st.last_commit <> h.head as has_new_commits
    from (select repo, max(tip) as head from {v_branches_new} group by repo) h left join
    (select o_custkey as repo, max(o_orderkey) as last_commit from {orders} where o_orderstatus <> 'P' and o_orderpriority <> '5-LOW' group by o_custkey) st on st.repo = h.repo""",
)
def _(s):
    heads = s["v_branches_new"].groupBy("repo").agg(F.max("tip").alias("head"))
    saved = s["orders"].where("o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'")
    state = saved.groupBy(F.col("o_custkey").alias("repo")).agg(F.max("o_orderkey").alias("last_commit"))
    return C.change_status(heads, state)


# Reachable commits per head, for every head the expected results ask about.
_ANCESTORS = """with recursive heads as ({heads}),
    up(repo, head, sha) as (
      select distinct c.repo, c.sha, c.sha from {v_commits} c join heads h on h.repo = c.repo and h.head = c.sha
      union
      select u.repo, u.head, c.parent from up u join {v_commits} c on c.repo = u.repo and c.sha = u.sha
      where c.parent is not null)
    """


def _ancestors(heads: str, commits: str = "{v_commits}") -> str:
    return _ANCESTORS.replace("{heads}", heads).replace("{v_commits}", commits)


def _commit_index(s: Source, view: str, table: str, batches: int = 1) -> CommitIndex:
    """The index of a view's commits, stored once for an application and the state of the supplied table.

    Commits come in batches of about equal ranges of their numbers; those that are there already are left out.
    """
    index = CommitIndex(s.spark, application_path(s.spark, "commit-index", view, s.folder, tables.stamp(s.spark, f"{s.folder}/{table}.parquet")))
    commits, known = s[view], index.ledger.current()
    if known is None or known["batch"] < batches - 1:
        ends = commits.agg(F.min("sha"), F.max("sha")).first()
        if ends[0] is not None:
            step = (ends[1] - ends[0]) / batches
            for i in range(batches):
                above = F.lit(True) if not i else F.col("sha") > ends[0] + i * step
                below = F.lit(True) if i == batches - 1 else F.col("sha") <= ends[0] + (i + 1) * step
                index.extend(commits.where(above & below), i)
    return index


@query(
    "commit_ancestors",
    _ancestors("select distinct repo, new as head from {v_moves}") + "select repo, head, count(*) as n_ancestors from up group by repo, head",
)
def _(s):
    history = _commit_index(s, "v_commits", "conversations")
    return H.ancestor_counts(history, s["v_moves"].select("repo", F.col("new").alias("head")))


@query(
    "force_push",
    _ancestors("select repo, new as head from {v_moves}")
    + "select m.repo, m.branch, m.old, m.new, u.sha is null as forced from {v_moves} m left join up u on u.repo = m.repo and u.head = m.new and u.sha = m.old",
)
def _(s):
    return H.force_push(_commit_index(s, "v_commits", "conversations"), s["v_moves"])


# Histories thousands of commits deep, indexed in two batches.
_DEEP = """with recursive commits as materialized (select repo, sha, parent from {v_deep_commits}), moves as materialized (select * from {v_deep_moves}),
    heads as (select repo, new as head from moves union select repo, old from moves where old is not null),
    up(repo, head, sha) as (
      select repo, head, head from heads
      union
      select u.repo, u.head, c.parent from up u join commits c on c.repo = u.repo and c.sha = u.sha where c.parent is not null)
    """


@query(
    "deep_force_push",
    _DEEP
    + """select m.repo, m.branch, m.old, m.new, u.sha is null as forced from moves m left join up u on u.repo = m.repo and u.head = m.new and u.sha = m.old""",
)
def _(s):
    return H.force_push(_commit_index(s, "v_deep_commits", "orders", 2), s["v_deep_moves"])


@query(
    "deep_new_commit_counts",
    _DEEP
    + """select m.repo, m.branch, m.old, m.new, m.old is null or m.old <> m.new as has_new_commits,
    case when m.old is null then 1 when m.old = m.new then 0 else count(u.sha) filter (v.sha is null) end as new_commit_count
    from moves m left join up u on u.repo = m.repo and u.head = m.new left join up v on v.repo = m.repo and v.head = m.old and v.sha = u.sha
    group by m.repo, m.branch, m.old, m.new""",
)
def _(s):
    return H.new_commit_counts(_commit_index(s, "v_deep_commits", "orders", 2), s["v_deep_moves"])


_NEW_COMMITS = _ancestors("select repo, new as head from {v_heads} union select repo, old from {v_heads}")


@query(
    "new_commits",
    _NEW_COMMITS
    + """select h.repo, h.old, h.new, u.sha from {v_heads} h join up u on u.repo = h.repo and u.head = h.new
    where (h.old is null and u.sha = h.new) or (h.old is not null and not exists
    (select 1 from up v where v.repo = h.repo and v.head = h.old and v.sha = u.sha))""",
)
def _(s):
    return H.new_commits(_commit_index(s, "v_commits", "conversations"), s["v_heads"])


@query(
    "new_commit_counts",
    _NEW_COMMITS
    + """select h.repo, h.old, h.new, h.old is null or h.old <> h.new as has_new_commits,
    case when h.old is null then 1 else (select count(*) from up u where u.repo = h.repo and u.head = h.new and not exists
    (select 1 from up v where v.repo = h.repo and v.head = h.old and v.sha = u.sha)) end as new_commit_count from {v_heads} h""",
)
def _(s):
    return H.new_commit_counts(_commit_index(s, "v_commits", "conversations"), s["v_heads"])


@query(
    "divergence",
    _ancestors("select repo, left_tip as head from {v_two_sides} union select repo, right_tip from {v_two_sides}")
    + """select repo, branch, left_tip, right_tip from {v_two_sides} t where left_tip <> right_tip
    and not exists (select 1 from up u where u.repo = t.repo and ((u.head = t.left_tip and u.sha = t.right_tip) or (u.head = t.right_tip and u.sha = t.left_tip)))""",
)
def _(s):
    sides = s["v_two_sides"]
    left = sides.select("repo", "branch", F.col("left_tip").alias("tip"))
    right = sides.select("repo", "branch", F.col("right_tip").alias("tip"))
    return H.divergence(None, left, right, index=_commit_index(s, "v_commits", "conversations"))


def _resolve_oracle(action: str, final: str, success: str) -> str:
    return f"""select coalesce(a.repo, b.repo) as repo, coalesce(a.branch, b.branch) as branch, a.tip as source_tip, b.tip as target_tip,
    {action} as action, {final} as final_tip, {success} as success
    from {{v_branches_old}} a full join {{v_branches_new}} b on a.repo = b.repo and a.branch = b.branch"""


@query("resolve_refs", _resolve_oracle("case when a.tip = b.tip then 'none' when a.tip is null then 'delete_target' else 'force_target' end", "a.tip", "true"))
def _(s):
    return C.resolve_refs(s["v_branches_old"], s["v_branches_new"], "source_wins")


@query(
    "resolve_refs_fail_fast",
    _resolve_oracle("case when a.tip = b.tip then 'none' else 'fail' end", "case when a.tip = b.tip then a.tip end", "coalesce(a.tip = b.tip, false)"),
)
def _(s):
    return C.resolve_refs(s["v_branches_old"], s["v_branches_new"], "fail_fast")


@query(
    "direction_totals",
    """select repo, case when count(distinct direction) > 1 then 'bidirectional' else min(direction) end as direction, bool_and(success) as success,
    cast(sum(commits_synced) as bigint) as commits_synced, cast(sum(branches_synced) as bigint) as branches_synced from {v_sync_results} group by repo""",
)
def _(s):
    return C.direction_totals(s["v_sync_results"])


@query(
    "ref_counts",
    """select coalesce(c.repo, r.repo) as repo, coalesce(c.n, 0) as n_commits, coalesce(r.n, 0) as n_branches from
    (select repo, count(distinct sha) as n from {v_commits} group by repo) c full join
    (select repo, count(distinct branch) as n from {v_branches_new} group by repo) r on c.repo = r.repo""",
)
def _(s):
    return C.ref_counts(s["v_commits"], s["v_branches_new"])


@query(
    "file_set_diff",
    """select coalesce(o.repo, n.repo) as repo, coalesce(o.file, n.file) as file,
    case when o.repo is null then 'added' when n.repo is null then 'removed' else 'unchanged' end as status
    from {v_files_old} o full join {v_files_new} n on o.repo = n.repo and o.file = n.file""",
)
def _(s):
    return C.file_set_diff(s["v_files_old"], s["v_files_new"])


_AUDIT = """(select repo, ts, seq, version, lag(version) over (partition by repo order by ts, seq, version) as old_version,
    min(ts) over (partition by repo, version) as first_ts,
    row_number() over (partition by repo, version order by ts, seq) as nth from {v_versions})"""


@query("version_audit", f"select repo, ts, seq, version, old_version from {_AUDIT} t where old_version <> version")
def _(s):
    return C.version_audit(s["v_versions"], ["repo"], ["ts", "seq", "version"])


@query("version_rollbacks", f"select repo, ts, seq, version, old_version from {_AUDIT} t where old_version <> version and nth > 1")
def _(s):
    return C.version_rollbacks(s["v_versions"], ["repo"], ["ts", "seq", "version"])


# === D: archives =========================================================================


@query(
    "archive_listing",
    """select archive_key as key, split_part(archive_key, '/', -1) as filename, size_bytes, mtime,
    case when archive_type = 'full' and archive_id % 3 = 0 then cast(archive_id as varchar) end as checksum_sha256,
    case when archive_type = 'full' then archive_type end as archive_type,
    case when archive_type = 'full' then 'repo-' || cast(repo as varchar) end as repository_name
    from {v_archives} where priority <> '5-LOW'""",
)
def _(s):
    return A.archive_listing(s["v_objects"], s["v_sidecars"]).drop("metadata")


@query(
    "catalogue_union",
    """select backend, key, size_bytes, mtime, case when backend <> 's3' then checksum_sha256 end as checksum_sha256 from {v_stores}""",
)
def _(s):
    times = {"azure": "last_modified", "gcs": "time_created"}
    objects = s["v_stores"]
    listings = {
        store: objects.where(F.col("backend") == store).drop("backend").withColumnRenamed("mtime", times.get(store, "mtime"))
        for store in ("local", "s3", "azure", "gcs", "oci", "s3_compatible")
    }
    return A.catalogue_union(listings)


@query(
    "archive_exists",
    "select key from {v_requests} where key in (select 'order-' || cast(archive_id as varchar) from {v_archives})",
)
def _(s):
    catalogue = s["v_archives"].select(F.concat(F.lit("order-"), F.col("archive_id").cast("string")).alias("key"))
    return A.archive_exists(s["v_requests"], catalogue)


@query("content_sha256", "select key, sha256(content) as sha256 from {v_expected}")
def _(s):
    return A.content_sha256(s["v_expected"])


@query(
    "checksum_verify",
    "select e.key, coalesce(sha256(e.content) = sha256(h.content), false) as verified from {v_expected} e left join {v_held} h on h.key = e.key",
)
def _(s):
    return A.checksum_verify(A.content_sha256(s["v_expected"]), A.content_sha256(s["v_held"]))


@query(
    "manifest_read",
    """select archive_id as archive, archive_id % 13 <> 0 as manifest_valid, case when archive_id % 13 <> 0 then archive_type end as type,
    case when archive_id % 13 <> 0 then 'c' || cast(archive_id as varchar) end as head_sha,
    case when archive_id % 13 <> 0 then archive_id % 2 = 0 end as lfs_enabled,
    case when archive_id % 13 <> 0 and archive_type = 'full' then archive_id % 5 end as lfs_object_count
    from {v_archives} where priority <> '5-LOW' or archive_type = 'full'""",
)
def _(s):
    return A.manifest_read(s.spread("v_manifest_text")).select(
        "archive", "manifest_valid", "manifest.type", "manifest.repository.head_sha", "manifest.lfs_enabled", "manifest.lfs_object_count"
    )


@query(
    "archive_verdict",
    """select archive, errors = '' as valid, errors, manifest_valid, bundle_valid, case when lfs then lfs_found and actual = expected end as lfs_objects_verified,
    case when lfs then actual end as lfs_object_count from (select *, concat_ws('|',
    case when has_manifest is null then 'manifest.json not found in archive' when not has_manifest then 'manifest.json is corrupted' end,
    case when not bundle_found then 'repository.bundle not found in archive' when not bundle_ok then 'Git bundle is invalid: bad object' end,
    case when lfs and not lfs_found then 'lfs-objects directory not found but lfs_enabled is True'
         when lfs and actual <> expected then 'LFS object count mismatch: expected ' || cast(expected as varchar) || ', found ' || cast(actual as varchar) end) as errors
    from (select m.archive, t.ok as has_manifest, coalesce(t.ok, false) as manifest_valid, m.bundle_found, m.bundle_ok, m.bundle_found and m.bundle_ok as bundle_valid,
    m.lfs_found, m.lfs_objects as actual, coalesce(t.ok, false) and m.archive % 2 = 0 as lfs,
    case when a.archive_type = 'full' then a.archive_id % 5 else 0 end as expected
    from {v_members} m join {v_archives} a on a.archive_id = m.archive
    left join (select archive, archive % 13 <> 0 as ok from {v_manifest_text}) t on t.archive = m.archive) x) y""",
)
def _(s):
    every = s["v_archives"].select(F.col("archive_id").alias("archive"))
    verdict = A.archive_verdict(every, A.manifest_read(s.spread("v_manifest_text")), s["v_members"])
    return verdict.withColumn("errors", F.array_join("errors", "|"))


@query("lfs_inventory", "select repo, count(*) as object_count, cast(sum(size_bytes) as bigint) as total_bytes from {v_lfs_objects} group by repo")
def _(s):
    return A.lfs_inventory(s["v_lfs_objects"])


def _chain_order():
    return [F.col("mtime"), F.col("archive_id")]


@query(
    "chain_validate",
    """select repo, count(*) as n_archives, min(p) filter (where bad) is null as valid,
    case when min(p) filter (where bad) = 0 then 'First archive must be a full archive'
         when min(p) filter (where bad) > 0 then 'Archive ' || cast(min(p) filter (where bad) as varchar) || ' must be an incremental archive' end as error
    from (select repo, p, case when p = 0 then archive_type <> 'full' else archive_type <> 'incremental' end as bad from
    (select repo, archive_type, row_number() over (partition by repo order by mtime, archive_id) - 1 as p from {v_archives}) a) b group by repo""",
)
def _(s):
    return A.chain_validate(A.chain_positions(s["v_archives"], ["repo"], _chain_order()), ["repo"])


@query(
    "chain_head",
    "select repo, 'c' || cast(archive_id as varchar) as final_head from (select *, row_number() over (partition by repo order by mtime desc, archive_id desc) as rn from {v_archives}) t where rn = 1",
)
def _(s):
    heads = s["v_archives"].withColumn("head_sha", F.concat(F.lit("c"), F.col("archive_id").cast("string")))
    return A.chain_head(heads, ["repo"], ["mtime", "archive_id"])


@query(
    "incremental_base",
    """select c.filename, c.parent_archive, p.head_sha as base_commit, c.range_from, c.head_sha as range_to, p.head_sha is null as parent_missing,
    coalesce(c.range_from <> p.head_sha, false) as gap from {v_chain} c left join {v_chain} p on p.filename = c.parent_archive where c.archive_type = 'incremental'""",
)
def _(s):
    return A.incremental_base(s["v_chain"])


_AGE = "epoch_us(timestamp '1999-01-01 00:00:00') - epoch_us(mtime) > cast(400 as bigint) * 86400000000"
_RANK = "row_number() over (partition by repo order by mtime desc, archive_key desc)"


@query("retention_by_age", f"select archive_key as key, repo, mtime, {_AGE} as \"delete\" from {{v_archives}}")
def _(s):
    return A.retention(_kept(s), ["repo"], AS_OF, max_age_days=400)


def _kept(s: Source) -> DataFrame:
    return s["v_archives"].select(F.col("archive_key").alias("key"), "repo", "mtime")


@query("retention_by_count", f"select archive_key as key, repo, mtime, {_RANK} > 3 as \"delete\" from {{v_archives}}")
def _(s):
    return A.retention(_kept(s), ["repo"], max_count=3)


@query("retention_combined", f"select archive_key as key, repo, mtime, {_RANK} > 3 or {_AGE} as \"delete\" from {{v_archives}}")
def _(s):
    return A.retention(_kept(s), ["repo"], AS_OF, max_age_days=400, max_count=3)


@query(
    "retention_summary",
    f"""select repo, count(*) filter (where d) as deleted_count, count(*) filter (where not d) as kept_count
    from (select repo, {_RANK} > 3 or {_AGE} as d from {{v_archives}}) t group by repo""",
)
def _(s):
    decided = A.retention(_kept(s), ["repo"], AS_OF, max_age_days=400, max_count=3)
    return A.retention_summary(decided, ["repo"])


@query(
    "storage_usage",
    """select repo, cast(sum(size_bytes) as bigint) as total_size_bytes, round_even(cast(sum(size_bytes) as double) / 1048576, 2) as total_size_mb
    from {v_archives} group by repo""",
)
def _(s):
    return A.storage_usage(s["v_archives"])


@query(
    "transfer_estimate",
    """select repo, size_mb, s as seconds, s / 60 as minutes, case when s / 60 < 1 then cast(cast(floor(s) as bigint) as varchar) || 's'
    when s / 60 < 60 then cast(cast(floor(s / 60) as bigint) as varchar) || 'm'
    else cast(cast(floor(s / 60 / 60) as bigint) as varchar) || 'h ' || cast(cast(floor(s / 60) as bigint) % 60 as varchar) || 'm' end as readable
    from (select repo, size_mb, size_mb / cast(0.125 as double) as s from (select repo, cast(sum(size_bytes) // 1048576 as bigint) as size_mb from {v_archives} group by repo) a) b""",
)
def _(s):
    sizes = s["v_archives"].groupBy("repo").agg(F.expr("sum(size_bytes) div 1048576").alias("size_mb"))
    return A.transfer_estimate(sizes, 0.125)


@query(
    "archive_name_parse",
    """select a.archive_id, n.filename, case when a.k <> 'other' then 'team-' || cast(a.repo as varchar) end as parsed_repo,
    case when a.k <> 'other' then a.k end as parsed_type, case when a.k <> 'other' then a.mtime end as parsed_time
    from (select *, case when archive_id % 5 = 0 then 'full-deps' when archive_id % 29 = 0 then 'other' else archive_type end as k from {v_archives}) a
    join {v_named_archives} n on n.archive_id = a.archive_id""",
)
def _(s):
    return A.archive_name_parse(s["v_named_archives"])


@query(
    "lfs_dedupe",
    """select sha256(content) as sha256, count(*) as copies, (count(*) - 1) * max(size_bytes) as saved_bytes from {v_blobs}
    group by sha256(content), size_bytes having count(*) > 1""",
)
def _(s):
    return A.lfs_dedupe(A.content_sha256(s["v_blobs"]))


@query("lfs_unreferenced", "select oid, size_bytes from {v_blobs} where oid not in (select doc_id from {labels})")
def _(s):
    return A.lfs_unreferenced(s["v_blobs"].select("oid", "size_bytes"), s["labels"].select(F.col("doc_id").alias("oid")))


@query(
    "lfs_patterns",
    """select p_partkey as repo, 1 as line_no, '*.' || lower(p_type) as pattern from {part}
    union all select p_partkey, 2, 'assets/**' from {part} where p_size > 25""",
)
def _(s):
    return A.lfs_patterns(s["v_attributes"])


@query("lfs_enabled", "select repo, contains(text, 'filter=lfs') as lfs_enabled from {v_attributes}")
def _(s):
    return A.lfs_enabled(s["v_attributes"])


# === E: languages and dependencies =======================================================

_LANGUAGES = """(select repo, file_path, case regexp_extract(file_path, '[^/]+$') when 'requirements.txt' then 'python' when 'package.json' then 'nodejs'
    when 'go.mod' then 'go' when 'app.csproj' then 'dotnet' when 'Cargo.toml' then 'rust' end as language from {v_files})"""


@query("detect_languages", f"select distinct repo, language from {_LANGUAGES} t where language is not null")
def _(s):
    return D.detect_languages(s["v_files"])


@query("repos_with_language", f"select distinct repo from {_LANGUAGES} t where language = 'dotnet'")
def _(s):
    return D.repos_with_language(s["v_files"], "dotnet")


@query(
    "language_metadata",
    f"""select repo, language, file_path, row_number() over (partition by repo, language order by string_split(file_path, '/')) as position,
    count(*) over (partition by repo, language) as manifest_count from {_LANGUAGES} t where language is not null""",
)
def _(s):
    return D.language_metadata(s["v_files"])


@query(
    "requirements_parse",
    """select repo, manifest, 1 as line_no, 'Requests' as name, 'security+socks' as extras, '>=2.' || cast(o_custkey as varchar) as version_spec, 'python_version < "3.8"' as markers
    from {v_requirement_files} join {orders} on o_orderkey = repo where manifest <> 'poetry.lock'
    union all select repo, manifest, 4, 'pkg_' || cast(o_custkey as varchar), '', '== 1.' || cast(o_orderkey as varchar) || '.0', ''
    from {v_requirement_files} join {orders} on o_orderkey = repo where manifest <> 'poetry.lock'
    union all select repo, manifest, 7, 'plain', '', '', '' from {v_requirement_files} where manifest <> 'poetry.lock'""",
)
def _(s):
    return D.requirements_parse(s.spread("v_requirement_files")).withColumn("extras", F.array_join("extras", "+"))


# Why a file is rejected, null if it is not.
_REJECTED = """case when o_orderpriority = '5-LOW' then null when o_orderkey % 13 = 0 then 'no text'
    when o_orderkey % 11 = 0 then case o_orderpriority when '1-URGENT' then 'project is not a table' when '2-HIGH' then 'poetry is not a table'
        when '3-MEDIUM' then 'packages is not a table' else 'not valid Python' end
    when o_orderkey % 17 = 0 and o_orderpriority = '1-URGENT' then 'dependencies is not a list of texts'
    when o_orderkey % 17 = 0 and o_orderpriority = '3-MEDIUM' then 'not valid TOML' end"""


@query(
    "structured_manifest_parse",
    f"""select f.repo, f.manifest, 0 as line_no, 'pkg-' || cast(o_custkey as varchar) as name, '' as extras,
    case o_orderpriority when '2-HIGH' then '^1.0' when '3-MEDIUM' then '' else '>=1.0' end as version_spec, '' as markers
    from {{v_structured_files}} f join {{orders}} on o_orderkey = f.repo where o_orderpriority <> '5-LOW' and {_REJECTED} is null
    union all select f.repo, f.manifest, 1, 'flask', case when o_orderpriority = '1-URGENT' then 'async' else '' end,
    case o_orderpriority when '2-HIGH' then '2.0' else '==2.0' end, case when o_orderpriority = '1-URGENT' then 'os_name == ''nt''' else '' end
    from {{v_structured_files}} f join {{orders}} on o_orderkey = f.repo where o_orderpriority <> '5-LOW' and {_REJECTED} is null""",
)
def _(s):
    return D.structured_manifest_parse(s.spread("v_structured_files")).withColumn("extras", F.array_join("extras", "+"))


@query(
    "structured_manifest_rejects",
    f"select f.repo, f.manifest, {_REJECTED} as reason from {{v_structured_files}} f join {{orders}} on o_orderkey = f.repo where {_REJECTED} is not null",
)
def _(s):
    return D.structured_manifest_rejects(s.spread("v_structured_files"))


@query("dependency_distinct", "select name, version_spec, count(distinct repo) as n_repos from {v_dependencies} group by name, version_spec")
def _(s):
    return D.dependency_distinct(s["v_dependencies"])


@query(
    "dependency_rows",
    """select repo, name, version_spec, row_number() over (partition by repo order by name, version_spec, l_suppkey, l_linenumber) as position,
    count(*) over (partition by repo) as dependency_count from {v_dependencies}""",
)
def _(s):
    order = [F.col(c) for c in ("name", "version_spec", "l_suppkey", "l_linenumber")]
    return D.dependency_rows(s["v_dependencies"], order).select("repo", "name", "version_spec", "position", "dependency_count")


@query(
    "dependency_manifest",
    """select repo, part, max(n) as dependency_count, '[' || string_agg('{{"name":"' || name || '","version_spec":"' || version_spec || '"}}', ',' order by rn) || ']' as dependencies
    from (select *, (rn - 1) // 3 as part from (select *, row_number() over (partition by repo order by name, version_spec) as rn,
    count(*) over (partition by repo) as n from {v_dependencies}) a) b group by repo, part""",
)
def _(s):
    return D.dependency_manifest(s["v_dependencies"].select("repo", "name", "version_spec"), [F.col("name"), F.col("version_spec")], part_size=3)


@query(
    "registry_flatten",
    """select name, version, case when p_size % 5 = 0 then '' else 'pkg-' || cast(id + 1 as varchar) || '>=1.0|six (>=1.4) ; extra == ''x''' end as requires,
    case when p_type in ('SMALL', 'LARGE') then 'https://files.example.org/' || name || '.whl' else '' end as wheel_url,
    case when p_type in ('SMALL', 'LARGE') then 'w' || cast(id as varchar) else '' end as wheel_sha256,
    case when p_type <> 'PROMO' then 'https://files.example.org/' || name || '.zip' else '' end as sdist_url,
    case when p_type <> 'PROMO' then 's' else '' end as sdist_sha256 from {v_registry}""",
)
def _(s):
    return D.registry_flatten(s.spread("v_registry_json")).withColumn("requires", F.array_join("requires", "|"))


# Major number below 6 and at least the wanted (major, minor); text that is no version constrains nothing.
_MEETS = """(select lower(r.name) as package, v.version, r.version_spec, r.l_linenumber = 7 or (v.id % 7 < 6 and
    (v.id % 7 > r.l_linenumber - 1 or (v.id % 7 = r.l_linenumber - 1 and v.p_size >= r.minor))) as ok
    from {v_requirements} r join {v_registry} v on v.id = r.l_partkey)"""


@query(
    "version_satisfies",
    f"select package, version, bool_and(ok) as compatible, count(distinct version_spec) as n_specs from {_MEETS} t group by package, version",
)
def _(s):
    return D.version_satisfies(s["v_registry"], s["v_requirements"])


@query(
    "version_conflicts",
    f"select package, version, version_spec, count(*) as n_requirements from {_MEETS} t where not ok group by package, version, version_spec",
)
def _(s):
    return D.version_conflicts(s["v_registry"], s["v_requirements"])


_ROOTS = "(select id from {v_registry} where id not in (select dep from {v_edges}))"
_REACHED = f"""with recursive walk(id, level) as (select id, 0 from {_ROOTS} r
    union select e.dep, w.level + 1 from walk w join {{v_edges}} e on e.pkg = w.id)
    """


@query(
    "transitive_closure",
    _REACHED + """select 'pkg-' || cast(w.id as varchar) as package, cast(min(w.level) as bigint) as level,
    case when max(r.id) is null then 'missing' else 'resolved' end as status, max(r.version) as version
    from walk w left join {v_registry} r on r.id = w.id group by w.id""",
)
def _(s):
    packages = s["v_registry"].select("id", "name", "version")
    edges = s["v_edges"].select(
        F.concat(F.lit("pkg-"), F.col("pkg").cast("string")).alias("package"),
        F.col("dep").alias("edge_no"),
        F.concat(F.lit("Pkg-"), F.col("dep").cast("string")).alias("name"),
        F.lit(">=0").alias("version_spec"),
    )
    needed = s["v_edges"].select(F.col("dep").alias("id"))
    roots = packages.join(needed, "id", "left_anti").select("name", F.lit("").alias("version_spec"), F.col("id").alias("ordinal"))
    return K.resolve(roots, packages, edges).select("package", "level", "status", "version")


@query(
    "registry_resolve",
    """with recursive asked as (
      select id as pkg, 0 as nth, 2 * id as dep, 'pkg-' || 2 * id as name, '>=1.0' as spec from {v_registry}
      union all select id, 1, 2 * id + 1, 'Pkg-' || (2 * id + 1), '<4' from {v_registry} where id % 5 <> 0
      union all select id, 2, 2 * id + 2, 'pkg-' || (2 * id + 2), '>=' || (id % 3) || '.0' from {v_registry} where (id & (id + 1)) <> 0
      union all select id, 3, -id, 'Nowhere-' || id, '' from {v_registry} where id % 4 = 0),
    edges as (select a.*, r.version, case when r.id is null then 'missing' when case nth when 0 then dep % 7 >= 1 when 1 then dep % 7 < 4
      else dep % 7 >= pkg % 3 end then 'resolved' else 'conflict' end as status from asked a left join {v_registry} r on r.id = a.dep),
    walk(id, level, name, spec, status, version, place) as (
      select id, 0, name, '', 'resolved', version, '' from {v_registry} where id = 1
      union all
      select e.dep, w.level + 1, arg_min(e.name, w.place || e.nth), arg_min(e.spec, w.place || e.nth), arg_min(e.status, w.place || e.nth),
        max(e.version), min(w.place || e.nth) from walk w join edges e on e.pkg = w.id where w.status = 'resolved' group by e.dep, w.level)
    select lower(name) as package, cast(level as bigint) as level, name as requested_as, spec as version_spec, status, version from walk""",
)
def _(s):
    packages = D.registry_flatten(s.spread("v_resolver_json"))
    roots = packages.where("name = 'Pkg-1'").select("name", F.lit("").alias("version_spec"), F.lit(0).alias("ordinal"))
    return K.resolve(roots, packages).drop("place")


@query(
    "edge_closure",
    _REACHED + "select id as package, cast(min(level) as bigint) as level from walk group by id",
)
def _(s):
    edges = s["v_edges"].select(F.col("pkg").alias("package"), F.col("dep").alias("needs"))
    roots = s["v_registry"].select(F.col("id").alias("package")).join(edges.select(F.col("needs").alias("package")), "package", "left_anti")
    return K.closure(roots, edges)


_ARTIFACT = "case when p_type in ('SMALL', 'LARGE') then name || '.whl' when p_type <> 'PROMO' then name || '.zip' else name || '-' || version || '.tar.gz' end"


@query("artifact_choice", f"select name, version, {_ARTIFACT} as filename from {{v_registry}}")
def _(s):
    return D.artifact_choice(D.registry_flatten(s.spread("v_registry_json")))


@query(
    "offline_requirements",
    f"""select d.repo, row_number() over (partition by d.repo order by v.id) + 1 as line_no, {_ARTIFACT} as line
    from (select distinct repo, l_partkey from {{v_requirements}}) d join {{v_registry}} v on v.id = d.l_partkey
    union all select distinct repo, 0, '{D.OFFLINE_HEADER}' from {{v_requirements}}
    union all select distinct repo, 1, '' from {{v_requirements}}""",
)
def _(s):
    chosen = D.artifact_choice(D.registry_flatten(s.spread("v_registry_json"))).withColumn("package", F.lower("name"))
    wanted = s["v_requirements"].select("repo", F.lower("name").alias("package"), F.col("l_partkey").alias("id")).distinct()
    return D.offline_requirements(wanted.join(chosen, "package"), [F.col("id")])


@query(
    "unresolved_dependencies",
    """select distinct 'pkg-' || cast(l_partkey + l_suppkey * 2 as varchar) as package from {lineitem}
    where l_partkey + l_suppkey * 2 not in (select p_partkey from {part})""",
)
def _(s):
    required = s["lineitem"].select(F.concat(F.lit("PKG-"), (F.col("l_partkey") + F.col("l_suppkey") * 2).cast("string")).alias("name"))
    return D.unresolved_dependencies(required, s["v_registry"])


# === F: operation logs ===================================================================


@query(
    "log_scan",
    """select event_id, case when ok then date_trunc('second', ts) + case when event_id % 2 = 0 then interval 250 millisecond else interval 0 millisecond end end as ts,
    case when ok then level end as level, case when ok then logger end as logger, case when ok then message end as message,
    case when ok then 'engine.py' end as filename, case when ok then user_id end as lineno, cast(null as varchar) as exception,
    case when ok then repository end as repository, case when ok and event_id % 41 <> 0 then cast(commits_synced as bigint) end as commits_synced,
    case when event_id % 31 = 0 then '{{"timestamp": ' when event_id % 37 = 0 then '[1, 2]' end as corrupt_line,
    case when ok then 'true' end as odd_key
    from (select *, event_id % 31 <> 0 and event_id % 37 <> 0 as ok from {v_log}) t""",
)
def _(s):
    scanned = L.log_scan(s.spread("v_log_lines"), {"repository": "STRING", "commits_synced": "BIGINT"})
    return scanned.withColumn("odd_key", F.try_variant_get("record", "$['odd key']", "string")).drop("record")


@query("avg_duration_by_repo", f"select repository, {_mean('duration_seconds')} as avg_duration from {{v_log}} where message = 'Repository sync completed' group by repository")
def _(s):
    return L.avg_duration_by_repo(s["v_log"])


@query("errors_per_5m", "select time_bucket(interval 5 minutes, ts) as bin, count(*) as n_errors from {v_log} where level = 'ERROR' group by 1")
def _(s):
    return L.errors_per_bin(s["v_log"])


@query(
    "top10_commits",
    "select repository, commits_synced, event_id from {v_log} where message = 'Repository sync completed' order by commits_synced desc, event_id limit 10",
)
def _(s):
    return L.top_commits(s["v_log"])


@query("status_counts", "select status, count(*) as n from {v_log} group by status")
def _(s):
    return L.status_counts(s["v_log"])


@query(
    "duration_timechart",
    f"select date_trunc('day', ts) as bin, repository, {_mean('duration_seconds')} as avg_duration from {{v_log}} where message = 'Repository sync completed' group by 1, 2",
)
def _(s):
    return L.duration_timechart(s["v_log"])


@query("error_table", "select ts, repository, error_type, message from {v_log} where level = 'ERROR'")
def _(s):
    return L.error_table(s["v_log"])


@query("failed_repos", "select distinct repository from {v_log} where status = 'failure'")
def _(s):
    return L.failed_repos(s["v_log"])


@query("avg_sync_time", f"select {_mean('duration_seconds')} as avg_duration from {{v_log}} where message = 'Repository sync completed'")
def _(s):
    return L.avg_sync_time(s["v_log"])


@query(
    "retry_attempts",
    "select repository, count(*) as n_retries, max(retry_attempt) as max_attempt from {v_log} where retry_attempt is not null group by repository",
)
def _(s):
    return L.retry_attempts(s["v_log"])


@query(
    "outcome_summary",
    """select count(*) as total, count(*) filter (where status = 'success') as successful, count(*) filter (where status <> 'success') as failed,
    round_even(cast(count(*) filter (where status = 'success') as double) / count(*) * 100, 2) as success_rate from {v_log} where status is not null""",
)
def _(s):
    results = s["v_log"].where("status is not null").select((F.col("status") == "success").alias("success"))
    return L.outcome_summary(results)


_RATE = """count(*) filter (where status = 'success') as n_success, count(*) filter (where status = 'failure') as n_failure,
    cast(count(*) filter (where status = 'success') as double) / count(*) as success_rate"""


@query("success_rate_5m", f"select time_bucket(interval 5 minutes, ts) as bin, {_RATE} from {{v_log}} where status in ('success', 'failure') group by 1")
def _(s):
    return L.success_rate(s["v_log"])


@query(
    "archive_size_trend",
    """select archive_type, bin, case when t1 > t0 then cast(s1 - s0 as double) / ((t1 - t0) / cast(1000000 as double)) end as bytes_per_second from (
    select archive_type, time_bucket(interval 1 hour, ts) as bin, epoch_us(min(ts)) as t0, epoch_us(max(ts)) as t1,
    min_by(size_bytes, (ts, event_id)) as s0, max_by(size_bytes, (ts, event_id)) as s1 from {v_gauges} group by 1, 2) t""",
)
def _(s):
    return L.archive_size_trend(s["v_gauges"])


@query(
    "counter_totals",
    """select repository, count(*) filter (where status = 'success') as sync_success_total, count(*) filter (where status = 'failure') as sync_failure_total,
    count(distinct case when status = 'success' then repository end) as repositories_synced_total,
    cast(coalesce(sum(case when status = 'success' then commits_synced end), 0) as bigint) as commits_synced_total,
    cast(coalesce(sum(case when status = 'success' then branches_synced end), 0) as bigint) as branches_synced_total
    from {v_log} where status is not null group by grouping sets ((repository), ())""",
)
def _(s):
    return L.counter_totals(s["v_log"])


@query("archive_bytes_by_type", "select archive_type, cast(sum(size_bytes) as bigint) as archive_size_bytes from {v_archives} group by archive_type")
def _(s):
    return L.archive_bytes_by_type(s["v_archives"])


@query("slow_operations", "select event_id, repository, duration_seconds from {v_log} where duration_seconds > 10")
def _(s):
    return L.slow_operations(s["v_log"]).select("event_id", "repository", "duration_seconds")


_ALERTS = """select event_id, 'checksum_mismatch' as alert, 'critical' as severity from {v_alert_rows} where checksum_verification = false
    union all select event_id, 'large_archive', 'warning' from {v_alert_rows} where archive_size_mb > 10000
    union all select event_id, 'slow_operation', 'warning' from {v_alert_rows} where operation_duration_seconds > 3600"""


@query("threshold_alerts", _ALERTS)
def _(s):
    return L.threshold_alerts(s["v_alert_rows"]).select("event_id", "alert", "severity")


@query(
    "error_type_breakdown",
    """select error_type, count(*) as n, count(*) filter (where error_type = 'NetworkError' and retryable) as n_retryable,
    cast(count(*) filter (where error_type = 'NetworkError' and retryable) as double) / count(*) as retryable_share
    from {v_log} where error_type is not null group by error_type""",
)
def _(s):
    return L.error_type_breakdown(s["v_log"])


@query(
    "retry_backoff_cost",
    """select repository, count(*) as n_waits, cast(sum(least(pow(2, commits_synced % 9), 60)) as double) as wait_high,
    cast(sum(least(pow(2, commits_synced % 9), 60)) as double) * 0.5 as wait_low from {v_log} where level = 'ERROR' group by repository""",
)
def _(s):
    retries = s["v_log"].where("level = 'ERROR'").select("repository", (F.col("commits_synced") % 9).alias("attempt"))
    return L.retry_backoff_cost(retries, ["repository"])


@query(
    "session_rollup",
    """select session_id, count(distinct case when status is not null then repository end) as total_repos, count(*) filter (where status = 'success') as successful,
    count(*) filter (where status = 'failure') as failed, cast(coalesce(sum(case when status = 'success' then commits_synced end), 0) as bigint) as total_commits,
    cast(coalesce(sum(case when status = 'success' then branches_synced end), 0) as bigint) as total_branches,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / cast(1000000 as double) as elapsed_seconds from {v_log} group by session_id""",
)
def _(s):
    return L.session_rollup(s["v_log"])


_STAGES = ["clone", "archive", "dependency", "upload"]


def _stage(stage: str) -> str:
    return f"coalesce(cast(sum(case when operation = '{stage}' then cast(duration_seconds as decimal(18,4)) end) as double), 0) as {stage}_duration"


@query("stage_timings", f"select session_id, {', '.join(_stage(x) for x in _STAGES)} from {{v_log}} group by session_id")
def _(s):
    return L.stage_timings(s["v_log"], _STAGES)


@query(
    "operation_pairing",
    """select url, ts as started_at, case when ns in ('completed', 'failed') then ns else 'unfinished' end as outcome,
    case when ns in ('completed', 'failed') then (epoch_us(nt) - epoch_us(ts)) / cast(1000000 as double) end as duration_seconds
    from (select *, lead(state) over w as ns, lead(ts) over w as nt from {v_notices} window w as (partition by url order by ts, seq)) t where state = 'started'""",
)
def _(s):
    return L.operation_pairing(s["v_notices"], [F.col("ts"), F.col("seq")])


_SECRETS = """select doc_id, 'token' as pattern from {documents} where regexp_matches(text, 'token', 'i')
    union all select doc_id, 'password' from {documents} where regexp_matches(text, 'password', 'i')
    union all select doc_id, 'secret' from {documents} where regexp_matches(text, 'secret', 'i')
    union all select doc_id, 'api_key' from {documents} where regexp_matches(text, 'api[_-]?key', 'i')"""


@query("secret_scan", _SECRETS)
def _(s):
    return L.secret_scan(s.spread("documents"), "doc_id")


@query("secret_counts", f"select pattern, count(*) as n_rows from ({_SECRETS}) t group by pattern")
def _(s):
    return L.secret_counts(s.spread("documents"), "doc_id")


@query(
    "audit_counts",
    "select date_trunc('day', ts) as bin, operation, count(*) as n from {v_log} where operation in ('clone', 'push') group by 1, 2",
)
def _(s):
    return L.audit_counts(s["v_log"])


@query("log_search", "select event_id, message from {v_log} where logger = 'estate.sync_engine' and message like '%completed%'")
def _(s):
    return L.log_search(s["v_log"], "estate.sync_engine", "completed").select("event_id", "message")


@query(
    "context_enrich",
    """select l.event_id, l.session_id, coalesce(o.environment, s.environment) as environment, s.outer_user
    from {v_log} l left join {v_sessions} s on s.session_id = l.session_id left join {v_operations} o on o.operation_id = l.event_id""",
)
def _(s):
    logs = s["v_log"].select("event_id", "session_id", F.col("event_id").alias("operation_id"), F.lit("line").alias("environment"))
    operations = s["v_operations"].withColumn("outer_user", F.lit(None).cast("bigint"))
    enriched = L.context_enrich(logs, s["v_sessions"], operations, ["environment", "outer_user"])
    return enriched.drop("operation_id")


# === G: streams ==========================================================================


class StreamSource(Source):
    """The same views over the supplied files read as a stream."""

    def __getitem__(self, name: str) -> DataFrame:
        table = super().__getitem__(name)
        if name != "events":
            return table
        # A pattern, because a plain path would have to be a folder.
        path = f"{self.folder}/events.parque[t]"
        rows = self.spark.readStream.schema(table.schema).parquet(path)
        return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(s: Source, stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    folder = scratch_path(s.spark, "stream")
    J.run_available(stream, J.update_table_sink(folder + "/out", stream.schema, keys), folder + "/checkpoint", mode)
    return UpdateTable(s.spark, folder + "/out", stream.schema, keys).read()


def _zoneless(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_errors_5m", "select time_bucket(interval 5 minutes, ts) as bin, count(*) as n_errors from {v_log} where level = 'ERROR' group by 1")
def _(s):
    live = StreamSource(s.spark, s.folder)
    return _zoneless(_streamed(s, J.stream_errors(live["v_log"]), ["bin"]), "bin")


@query(
    "stream_success_rate",
    f"""select bin, {_RATE} from (select status, time_bucket(interval 1 minute, ts) - to_minutes(cast(k as bigint)) as bin
    from {{v_log}} join (select unnest([0, 1, 2, 3, 4]) as k) n on true where status is not null) t group by bin""",
)
def _(s):
    live = StreamSource(s.spark, s.folder)
    return _zoneless(_streamed(s, J.stream_success_rate(live["v_log"]), ["bin"]), "bin")


@query(
    "stream_latest_state",
    """select repository as repo, ts, event_id as seq, status, commits_synced from (select *, row_number() over (partition by repository order by ts desc, event_id desc) as rn
    from {v_log}) t where rn = 1""",
)
def _(s):
    live = StreamSource(s.spark, s.folder)
    writes = live["v_log"].select(F.col("repository").alias("repo"), "ts", F.col("event_id").alias("seq"), "status", "commits_synced")
    folder = scratch_path(s.spark, "state")
    J.run_available(writes, J.state_table_sink(folder + "/out", writes.schema, buckets=16), folder + "/checkpoint", "append")
    return _zoneless(StateTable(s.spark, folder + "/out", writes.schema).read(), "ts")


@query(
    "stream_operation_pairing",
    """select a.operation_id, a.url, a.ts as started_at, b.ts as ended_at, coalesce(b.state, 'unfinished') as outcome
    from {v_notices} a left join {v_notices} b on b.operation_id = a.operation_id and b.state <> 'started' where a.state = 'started'""",
)
def _(s):
    live = StreamSource(s.spark, s.folder)
    # The clock goes on after the last notice, as it does in a stream that does not end, so that
    # operations without an end leave the stream by themselves.
    clock = scratch_path(s.spark, "clock")
    last = s["v_notices"].agg((F.max("ts").cast("timestamp") + F.expr("interval 1 day")).alias("ts"))
    tick = last.select(F.lit(-1).cast("bigint").alias("operation_id"), F.lit(None).cast("bigint").alias("url"), "ts", F.lit("tick").alias("state"))
    tick.write.parquet(clock)

    def side(condition: str) -> DataFrame:
        notices = live["v_notices"].where(condition).select("operation_id", "url", "ts", "state")
        return notices.unionAll(s.spark.readStream.schema(tick.schema).parquet(clock))

    stream = J.stream_operation_pairing(side("state = 'started'"), side("state <> 'started'"))
    paired = _streamed(s, stream, ["operation_id"], "append").where("operation_id >= 0")
    return _zoneless(paired.withColumn("outcome", F.coalesce("end_state", F.lit("unfinished"))).drop("end_state"), "started_at", "ended_at")


@query("stream_alerts", _ALERTS)
def _(s):
    live = StreamSource(s.spark, s.folder)
    alerts = J.stream_alerts(live["v_alert_rows"]).select("event_id", "alert", "severity")
    return _streamed(s, alerts, ["event_id", "alert"], "append")


# === H: sources and sinks ================================================================


def _stored(s: Source) -> str:
    """A new folder with one object per supplier, named ``repo=<key>/part-….txt``."""
    path = scratch_path(s.spark, "store")
    tables.write_objects(s["v_stored"], path, "repo", "value")
    return path


def _repo(name: str = "key"):
    return F.regexp_extract(name, "repo=([0-9]+)/", 1).cast("bigint").alias("repo")


@query(
    "source_log_lines",
    """select case when ok then date_trunc('second', ts) + case when event_id % 2 = 0 then interval 250 millisecond else interval 0 millisecond end end as ts,
    case when ok then level end as level, case when ok then repository end as repository, case when ok then user_id end as lineno,
    case when event_id % 31 = 0 then '{{"timestamp": ' when event_id % 37 = 0 then '[1, 2]' end as corrupt_line
    from (select *, event_id % 31 <> 0 and event_id % 37 <> 0 as ok from {v_log}) t""",
)
def _(s):
    path = scratch_path(s.spark, "logs")
    tables.write_json_values(s.spread("v_log_lines"), path, "value")
    scanned = L.log_scan(tables.log_lines(s.spark, path), {"repository": "STRING"})
    return scanned.select("ts", "level", "repository", "lineno", "corrupt_line")


@query(
    "source_json_documents",
    """select repo, value not like '%: ' as manifest_valid, case when value not like '%: ' then json_extract_string(value, '$.type') end as type,
    case when value not like '%: ' then json_extract_string(value, '$.repository.name') end as name,
    case when value not like '%: ' then contains(value, '"lfs_enabled": true') end as lfs_enabled from {v_stored}""",
)
def _(s):
    manifests = A.manifest_read(tables.json_documents(s.spark, _stored(s), "*.txt"))
    return manifests.select(_repo(), "manifest_valid", "manifest.type", "manifest.repository.name", "manifest.lfs_enabled")


@query("source_object_digests", "select repo, strlen(value) + 1 as size_bytes, sha256(value || chr(10)) as sha256 from {v_stored}")
def _(s):
    return tables.object_digests(s.spark, _stored(s), "*.txt").select(_repo(), "size_bytes", "sha256")


@query("source_object_listing", "select repo, strlen(value) + 1 as size_bytes, true as timed from {v_stored}")
def _(s):
    listing = tables.object_listing(s.spark, _stored(s), "*.txt")
    return listing.select(_repo(), "size_bytes", F.col("mtime").isNotNull().alias("timed"))


@query(
    "source_text_files",
    "select repo, split_part(line, '>=', 1) as name, '>=' || split_part(line, '>=', 2) as version_spec from {v_listed}",
)
def _(s):
    path = scratch_path(s.spark, "lists")
    tables.write_lines(s["v_listed"], path)
    files = tables.text_files(s.spark, path, "*.txt").select(_repo(), F.lit("requirements.txt").alias("manifest"), "text")
    return D.requirements_parse(files).select("repo", "name", "version_spec")


@query(
    "sink_lines",
    "select repo, row_number() over (partition by repo order by line_no) as position, line from {v_listed}",
)
def _(s):
    path = scratch_path(s.spark, "lists")
    tables.write_lines(s["v_listed"], path)
    # The files of a list, in the order of their names, are its lines in order.
    files = tables.text_files(s.spark, path, "*.txt")
    lines = files.select("key", _repo(), F.posexplode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("nth", "line"))
    return order_in_group(lines, ["repo"], [F.col("key"), F.col("nth")]).select("repo", "position", "line")


@query("sink_json_values", "select value as line from {v_registry_json}")
def _(s):
    path = scratch_path(s.spark, "values")
    tables.write_json_values(s["v_registry_json"], path, "value")
    return tables.log_lines(s.spark, path).select(F.col("value").alias("line"))


@query(
    "sink_state_snapshot",
    "select repo, ts, seq, last_commit, branch from (select *, row_number() over (partition by repo order by ts desc, seq desc) as rn from {v_state_log}) t where rn = 1",
)
def _(s):
    log = s["v_state_log"]
    table = StateTable(s.spark, scratch_path(s.spark, "state"), log.schema, buckets=16)
    table.merge(log.where("branch <> '1-URGENT'"), 0)
    table.merge(log.where("branch = '1-URGENT' and repo < 1000"), 1)
    # A batch that was taken in already is left alone.
    table.merge(log.where("branch = '1-URGENT'"), 1)
    table.merge(log.where("branch = '1-URGENT' and repo >= 1000"), 2)
    table.expire(2)
    return table.read()
