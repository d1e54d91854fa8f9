"""Estate tables derived from the supplied tables.

Each view is plain SQL that means the same in Spark and in the oracle engine. Names in braces
are supplied tables or other views. Every view scans its tables whole; some leave rows out by a
condition on their values, so that lookups into them miss.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS = {
    # Projects. One region name contains a space, which makes invalid target names.
    "v_repos": """
        select c.c_custkey as id, c.c_name as name,
               r.r_name || '/' || n.n_name || '/' || replace(c.c_name, '#', '-') as path,
               'https://git.example.org/' || r.r_name || '/' || n.n_name || '/' || replace(c.c_name, '#', '-') as web_url,
               c.c_mktsegment as segment, c.c_acctbal as acctbal
        from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey
        join {region} r on n.n_regionkey = r.r_regionkey""",
    # Paths whose last parts collide.
    "v_paths": """
        select p_partkey as id,
               lower(p_type) || '/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-') as path
        from {part}""",
    # The same paths as people type them: doubled, leading and trailing slashes, blanks.
    "v_messy_paths": """
        select p.p_partkey as id, case when p.p_size < 10 then '//' || replace(v.path, '/', '///') || '/'
               when p.p_size < 15 then '   ' when p.p_size < 20 then null else v.path end as path
        from {part} p join {v_paths} v on v.id = p.p_partkey""",
    "v_names": """
        select id, case id % 9 when 0 then name || '.git' when 1 then '-' || name when 2 then '..'
                               when 3 then repeat(name, 8) when 4 then '' when 5 then name || ' x'
                               else name end as target_name
        from (select p_partkey as id, replace(p_name, ' ', '-') as name from {part}) t""",
    "v_details": """
        select c.c_custkey as id,
               case when c.c_acctbal >= 0 then 'Team ' || c.c_mktsegment end as description,
               case when c.c_acctbal >= 2000 then lower(c.c_mktsegment) || ',estate' end as topic_text,
               case c.c_mktsegment when 'BUILDING' then 'public' when 'MACHINERY' then 'internal'
                                   when 'HOUSEHOLD' then null else 'private' end as visibility,
               case when c.c_acctbal > 5000 then 'develop' end as default_branch
        from {customer} c join {labels} l on l.doc_id = c.c_custkey""",
    "v_targets": """
        select distinct 'acme/' || replace(r.path, '/', '-') as full_name
        from {v_repos} r join {orders} o on o.o_custkey = r.id where o.o_orderstatus = 'P' and o.o_orderpriority = '5-LOW'""",
    "v_group_map": """
        select r_name as prefix, 'org-' || lower(replace(r_name, ' ', '-')) as value from {region} where r_name <> 'ASIA'
        union all
        select r_name || '/' || n_name, 'org-nation-' || cast(n_nationkey as varchar(10))
        from {nation} join {region} on n_regionkey = r_regionkey where n_name like '%2%'
        union all
        select path, 'single-' || cast(id as varchar(20)) from {v_repos} where acctbal > 9900""",
    "v_group_config": """
        select n_name as group_name, case when n_regionkey = 1 then 50 end as clone_depth,
               case when n_regionkey in (0, 3) then true when n_regionkey = 2 then false end as lfs_enabled,
               case when n_nationkey >= 15 then 'incremental' end as sync_strategy
        from {nation} where n_name <> 'NATION_7'""",
    # Names and globs that one group excludes and others keep.
    "v_excludes": """
        select n_name as group_name, r_name || '/' || n_name || '/' || '*' || cast(n_nationkey % 10 as varchar(10)) as entry
        from {nation} join {region} on n_regionkey = r_regionkey where n_nationkey % 2 = 0
        union all select n_name, '*_%' from {nation}
        union all select n_name, r.path from {nation} join {v_repos} r on r.id % 25 = n_nationkey where r.segment = 'BUILDING'""",
    "v_remotes": """
        select case c_mktsegment when 'BUILDING' then 'https://github.com/' when 'MACHINERY' then 'https://Code.GitHub.com/'
                    when 'HOUSEHOLD' then 'https://gitlab.corp.example:8443/' when 'FURNITURE' then 'git@github.com:'
                    else 'https://tok@github.com/' end || replace(c_name, '#', '-') || '.git' as url from {customer}
        union all select 'https://gitlab.com/' || replace(s_name, '#', '-') as url from {supplier}
        union all select url from {pages}""",
    # State, refs and commits.
    "v_archives": """
        select o_orderkey as archive_id, o_custkey as repo,
               'repo-' || cast(o_custkey as varchar(20)) || '/' || cast(o_orderkey as varchar(20)) || '.tar.gz' as archive_key,
               case when o_orderstatus = 'F' then 'full' else 'incremental' end as archive_type,
               cast(round(o_totalprice * 100) as bigint) as size_bytes, o_orderdate as mtime, o_orderpriority as priority
        from {orders}""",
    "v_state_log": """
        select o_custkey as repo, o_orderdate as ts, o_orderkey as seq,
               'c' || cast(o_orderkey as varchar(20)) as last_commit, o_orderpriority as branch from {orders}""",
    "v_branches_old": """
        select o_custkey as repo, o_orderpriority as branch, max(o_orderkey) as tip
        from {orders} where o_orderdate < timestamp '1998-01-01 00:00:00' group by o_custkey, o_orderpriority""",
    "v_branches_new": """
        select o_custkey as repo, o_orderpriority as branch, max(o_orderkey) as tip
        from {orders} where o_orderdate >= timestamp '1998-01-01 00:00:00' group by o_custkey, o_orderpriority""",
    # Every third turn forks; every fifth merges the commit three before it.
    "v_commits": """
        select conv_id as repo, conv_id * 1000 + turn as sha,
               case when turn = 0 then null when turn % 3 = 0 then conv_id * 1000 + turn - 2
                    else conv_id * 1000 + turn - 1 end as parent, 0 as parent_no
        from {conversations}
        union all
        select conv_id, conv_id * 1000 + turn, conv_id * 1000 + turn - 3, 1 from {conversations} where turn % 5 = 4""",
    # Few repositories with long histories. Every fortieth commit leaves three behind on a side branch, and two of three
    # such branches are merged back later.
    "v_deep_numbered": """
        select o_orderkey % 5 as repo, o_orderkey as sha, o_orderpriority as priority, o_orderstatus as status, o_orderdate as ts,
               row_number() over (partition by o_orderkey % 5 order by o_orderkey) as nth,
               lag(o_orderkey) over (partition by o_orderkey % 5 order by o_orderkey) as before,
               lag(o_orderkey, 4) over (partition by o_orderkey % 5 order by o_orderkey) as fork,
               lag(o_orderkey, 11) over (partition by o_orderkey % 5 order by o_orderkey) as side from {orders}""",
    "v_deep_commits": """
        select repo, sha, case when nth % 40 = 0 then fork else before end as parent, 0 as parent_no from {v_deep_numbered}
        union all
        select repo, sha, side, 1 from {v_deep_numbered} where nth % 40 = 10 and nth % 120 <> 10 and nth > 11""",
    # A branch for each priority and year; it was at its last finished commit and is at its last one.
    "v_deep_moves": """
        select repo, priority || '-' || cast(extract(year from ts) as varchar(10)) as branch,
               max(case when status = 'F' then sha end) as old, max(sha) as new
        from {v_deep_numbered} group by repo, priority || '-' || cast(extract(year from ts) as varchar(10))""",
    "v_tips": """
        select conv_id as repo, max(turn) as m, conv_id * 1000 + max(turn) as tip from {conversations} group by conv_id""",
    # Moves of refs: forward, sideways onto a fork, rewound, and to a commit nobody has.
    "v_moves": """
        select repo, 'main' as branch, repo * 1000 + m - 1 as old, tip as new from {v_tips} where m >= 1
        union all select repo, 'fork', repo * 1000 + m - 1, repo * 1000 + (m - m % 3) from {v_tips} where m >= 1
        union all select repo, 'rewind', tip, repo * 1000 from {v_tips}
        union all select repo, 'same', tip, tip from {v_tips}
        union all select repo, 'lost', repo * 1000 + 999, tip from {v_tips}""",
    "v_heads": """
        select repo, tip as new, case m % 4 when 0 then null when 1 then tip when 2 then tip - 1
                                            else repo * 1000 end as old from {v_tips}""",
    "v_two_sides": """
        select repo, 'main' as branch, tip as left_tip, tip - 1 as right_tip from {v_tips} where m >= 1
        union all select repo, 'dev', repo * 1000 + m - 1, repo * 1000 + (m - m % 3) from {v_tips} where m >= 1
        union all select repo, 'topic', repo * 1000, tip from {v_tips}""",
    "v_files_old": "select distinct l_orderkey as repo, l_suppkey as file from {lineitem} where l_returnflag <> 'A'",
    "v_files_new": "select distinct l_orderkey as repo, l_suppkey as file from {lineitem} where l_returnflag <> 'N'",
    "v_sync_results": """
        select o_custkey as repo, case when o_orderstatus = 'F' then 'target_to_source' else 'source_to_target' end as direction,
               o_orderpriority <> '5-LOW' as success,
               case when o_orderpriority = '5-LOW' then 0 else o_orderkey % 50 end as commits_synced,
               case when o_orderpriority = '5-LOW' then 0 else o_orderkey % 4 end as branches_synced from {orders}""",
    "v_versions": """
        select l_partkey as repo, l_shipdate as ts, l_orderkey * 10 + l_linenumber as seq,
               'v' || cast(l_suppkey % 4 as varchar(10)) as version from {lineitem}""",
    # Archives.
    "v_objects": """
        select archive_key || case when priority = '5-LOW' then '.tmp' else '' end as key, size_bytes, mtime from {v_archives}""",
    "v_sidecars": """
        select archive_key || '.meta.json' as key,
               '{{"archive_type": "' || archive_type || '", "repository_name": "repo-' || cast(repo as varchar(20)) || '"' ||
               case when archive_id % 3 = 0 then ', "checksum_sha256": "' || cast(archive_id as varchar(20)) || '"' else '' end || '}}' as value
        from {v_archives} where archive_type = 'full'""",
    "v_stores": """
        select case archive_id % 6 when 0 then 'local' when 1 then 's3' when 2 then 'azure' when 3 then 'gcs'
                    when 4 then 'oci' else 's3_compatible' end as backend,
               archive_key as key, size_bytes, mtime, 'd' || cast(archive_id as varchar(20)) as checksum_sha256 from {v_archives}""",
    "v_requests": """
        select distinct 'order-' || cast(l_orderkey + l_linenumber * 100 as varchar(20)) as key from {lineitem}""",
    "v_expected": "select doc_id as key, text as content from {documents}",
    "v_held": """
        select d.doc_id as key, case when l.quality = 0 then d.text || '!' else d.text end as content
        from {documents} d join {labels} l on l.doc_id = d.doc_id""",
    "v_manifest_text": """
        select archive_id as archive,
               case when archive_id % 13 = 0 then '{{"type": "full", ' else
               '{{"type": "' || archive_type || '", "repository": {{"name": "repo-' || cast(repo as varchar(20)) ||
               '", "head_sha": "c' || cast(archive_id as varchar(20)) || '"}}, "lfs_enabled": ' ||
               case when archive_id % 2 = 0 then 'true' else 'false' end ||
               case when archive_type = 'full' then ', "lfs_object_count": ' || cast(archive_id % 5 as varchar(10)) else '' end ||
               '}}' end as value
        from {v_archives} where priority <> '5-LOW' or archive_type = 'full'""",
    # One manifest per supplier, as small objects of a store; some are cut short.
    "v_stored": """
        select s_suppkey as repo, case when s_suppkey % 7 = 0 then '{{"type": ' else
               '{{"type": "' || case when s_nationkey % 2 = 0 then 'full' else 'incremental' end || '", "repository": {{"name": "' ||
               s_name || '"}}, "lfs_enabled": ' || case when s_acctbal > 0 then 'true' else 'false' end || '}}' end as value
        from {supplier}""",
    # A list per supplier whose order is not that of its text.
    "v_listed": """
        select l_suppkey as repo, cast(l_partkey as bigint) as line_no, 'pkg-' || cast(l_partkey as varchar(20)) || '>=' ||
               cast(min(l_linenumber) as varchar(10)) || '.0' as line
        from {lineitem} group by l_suppkey, l_partkey""",
    "v_members": """
        select a.archive_id as archive, a.size_bytes % 19 <> 0 as bundle_found, a.size_bytes % 23 <> 0 as bundle_ok,
               'bad object' as bundle_error, coalesce(l.n, 0) > 0 as lfs_found, coalesce(l.n, 0) as lfs_objects
        from {v_archives} a left join (select l_orderkey, count(*) as n from {lineitem} group by l_orderkey) l
        on l.l_orderkey = a.archive_id""",
    "v_named_archives": """
        select archive_id, 'team-' || cast(repo as varchar(20)) || '-' ||
               case when archive_id % 5 = 0 then 'full-deps' when archive_id % 29 = 0 then 'other' else archive_type end || '-' ||
               replace(substr(cast(mtime as varchar(30)), 1, 10), '-', '') || '-' ||
               replace(substr(cast(mtime as varchar(30)), 12, 8), ':', '') || '.tar.gz' as filename from {v_archives}""",
    "v_chain": """
        select 'a-' || cast(archive_id as varchar(20)) as filename, archive_type,
               'c' || cast(archive_id as varchar(20)) as head_sha,
               case when archive_type = 'incremental' then 'a-' || cast(archive_id - 1 as varchar(20)) end as parent_archive,
               case when archive_type = 'incremental' then
                    'c' || cast(archive_id - case when size_bytes % 5 = 0 then 2 else 1 end as varchar(20)) end as range_from
        from {v_archives}""",
    "v_lfs_objects": "select l_orderkey as repo, cast(l_quantity as bigint) * 4096 as size_bytes from {lineitem}",
    "v_blobs": "select doc_id as oid, text as content, n_chars as size_bytes from {documents}",
    "v_attributes": """
        select p_partkey as repo, '# large files' || chr(10) || '*.' || lower(p_type) || ' filter=lfs diff=lfs merge=lfs -text' || chr(10) ||
               case when p_size > 25 then '   assets/** filter=lfs -text' else '* text=auto' end || chr(10) || chr(10) ||
               '# *.old filter=lfs' as text from {part}""",
    # Files, dependencies and the registry.
    "v_files": """
        select 'repo-' || cast(p_size as varchar(10)) as repo,
               'dir' || cast(p_partkey as varchar(20)) || '/' ||
               case p_type when 'ECONOMY' then 'requirements.txt' when 'SMALL' then 'package.json' when 'LARGE' then 'go.mod'
                           when 'PROMO' then 'app.csproj' when 'STANDARD' then 'Cargo.toml' else 'README.md' end as file_path
        from {part}""",
    "v_requirement_files": """
        select o_orderkey as repo, case when o_orderstatus = 'F' then 'sub/requirements-dev.txt'
                                        when o_orderstatus = 'P' then 'poetry.lock' else 'requirements.txt' end as manifest,
               '# generated' || chr(10) || 'Requests[security, socks]>=2.' || cast(o_custkey as varchar(20)) ||
               ' ; python_version < "3.8"' || chr(10) || chr(10) || '-r base.txt' || chr(13) || chr(10) ||
               '  pkg_' || cast(o_custkey as varchar(20)) || ' == 1.' || cast(o_orderkey as varchar(20)) || '.0 # pinned' || chr(10) ||
               'git+https://host.example/x.git' || chr(10) || '_odd>=1' || chr(10) || 'plain' as text
        from {orders}""",
    # Some cannot be read: no text, members of the wrong kind, text that is no TOML or Python.
    "v_structured_files": """
        select o_orderkey as repo, case o_orderpriority when '1-URGENT' then 'pyproject.toml' when '2-HIGH' then 'svc/pyproject.toml'
                    when '3-MEDIUM' then 'Pipfile' when '4-NOT SPECIFIED' then 'setup.py' else 'notes.md' end as manifest,
               case when o_orderkey % 13 = 0 then null when o_orderkey % 11 = 0 then
                 case o_orderpriority when '1-URGENT' then 'project = 3' when '2-HIGH' then '[tool]' || chr(10) || 'poetry = [1]'
                   when '3-MEDIUM' then '[[packages]]' || chr(10) || 'flask = "*"' when '4-NOT SPECIFIED' then 'setup(' else '' end
               when o_orderkey % 17 = 0 and o_orderpriority = '1-URGENT' then '[project]' || chr(10) || 'dependencies = "abc"'
               when o_orderkey % 17 = 0 and o_orderpriority = '3-MEDIUM' then '[packages'
               else case o_orderpriority
                 when '1-URGENT' then '[project]' || chr(10) || 'name = "x"' || chr(10) || 'dependencies = ["pkg-' ||
                      cast(o_custkey as varchar(20)) || '>=1.0", "flask[async]==2.0 ; os_name == ''nt''"]'
                 when '2-HIGH' then '[tool.poetry.dependencies]' || chr(10) || 'python = "^3.9"' || chr(10) || 'pkg-' ||
                      cast(o_custkey as varchar(20)) || ' = "^1.0"' || chr(10) || 'flask = {{version = "2.0", optional = true}}'
                 when '3-MEDIUM' then '[packages]' || chr(10) || 'pkg-' || cast(o_custkey as varchar(20)) || ' = "*"' || chr(10) ||
                      'flask = {{version = "==2.0"}}' || chr(10) || '[dev-packages]' || chr(10) || 'pytest = "*"'
                 when '4-NOT SPECIFIED' then 'from setuptools import setup' || chr(10) || 'setup(name="x", install_requires=["pkg-' ||
                      cast(o_custkey as varchar(20)) || '>=1.0", "flask==2.0"])'
                 else 'nothing' end end as text
        from {orders}""",
    "v_dependencies": """
        select l_orderkey as repo, 'pkg-' || cast(l_partkey as varchar(20)) as name,
               '>=' || cast(l_linenumber as varchar(10)) || '.0' as version_spec, l_partkey, l_suppkey, l_linenumber from {lineitem}""",
    # The latest version of part p is (p % 7).(p_size).0; suppliers required by a part are its
    # requirements when their number is smaller, which keeps the graph free of cycles.
    "v_edges": "select distinct l_partkey as pkg, l_suppkey as dep from {lineitem} where l_suppkey < l_partkey",
    "v_registry": """
        select p_partkey as id, 'Pkg-' || cast(p_partkey as varchar(20)) as name,
               cast(p_partkey % 7 as varchar(10)) || '.' || cast(p_size as varchar(10)) || '.0' as version, p_size,
               p_type from {part}""",
    "v_registry_json": """
        select id, '{{"info": {{"name": "' || name || '", "version": "' || version || '", "requires_dist": ' ||
               case when p_size % 5 = 0 then 'null' else '["pkg-' || cast(id + 1 as varchar(20)) || '>=1.0", "six (>=1.4) ; extra == ''x''"]' end ||
               '}}, "urls": [' ||
               case when p_type in ('SMALL', 'LARGE') then
                 '{{"packagetype": "bdist_wheel", "url": "https://files.example.org/old.whl", "digests": {{"sha256": "w0"}}}}, ' ||
                 '{{"packagetype": "bdist_wheel", "url": "https://files.example.org/' || name || '.whl", "digests": {{"sha256": "w' || cast(id as varchar(20)) || '"}}}}, '
                 else '' end ||
               case when p_type = 'PROMO' then '{{"packagetype": "bdist_egg", "url": "https://files.example.org/x.egg"}}' else
                 '{{"packagetype": "sdist", "url": "https://files.example.org/' || name || '.zip", "digests": {{"sha256": "s"}}}}' end ||
               ']}}' as value
        from {v_registry}""",
    # Packages in layers: p needs 2p, 2p + 1 and, within the layer below, 2p + 2, so that most are reached twice by
    # requirements that differ. Some requirements cannot be read, fail, or name a package that is not there.
    "v_resolver_json": """
        select id, '{{"info": {{"name": "' || name || '", "version": "' || version || '", "requires_dist": ["pkg-' ||
               cast(2 * id as varchar(20)) || '>=1.0", "Pkg-' || cast(2 * id + 1 as varchar(20)) ||
               case when id % 5 = 0 then ' >=0 <4"' else ' (<4)"' end ||
               case when (id & (id + 1)) <> 0 then ', "pkg-' || cast(2 * id + 2 as varchar(20)) || '[x] >= ' || cast(id % 3 as varchar(10)) ||
                    '.0 ; extra == ''y''"' else '' end ||
               case when id % 4 = 0 then ', "Nowhere-' || cast(id as varchar(20)) || '"' else '' end || ']}}, "urls": []}}' as value
        from {v_registry}""",
    # Requirements with two bounds on the major number.
    "v_requirements": """
        select l_orderkey as repo, 'PKG-' || cast(l_partkey as varchar(20)) as name,
               case when l_linenumber = 7 then 'not a version' else
               '>=' || cast(l_linenumber - 1 as varchar(10)) || '.' || cast(l_suppkey % 50 as varchar(10)) || ',<6' end as version_spec,
               l_partkey, l_linenumber, l_suppkey % 50 as minor
        from {lineitem}""",
    # The log.
    "v_log": """
        select event_id, ts, 'repo-' || cast(user_id as varchar(20)) as repository, user_id,
               case when event_type = 'error' then 'ERROR' else 'INFO' end as level,
               case when event_type in ('purchase', 'error') then 'estate.sync_engine' else 'estate.git_client' end as logger,
               case when event_type = 'purchase' then 'Repository sync completed'
                    when event_type = 'error' then 'Repository sync failed'
                    when event_type = 'signup' then 'Cloning repository from source'
                    else 'Pushing repository to target' end as message,
               case when event_type = 'purchase' then 'success' when event_type = 'error' then 'failure' end as status,
               value as duration_seconds, cast(regexp_extract(props, '([0-9]+)', 1) as int) as commits_synced,
               cast(user_id % 5 as int) as branches_synced,
               case event_type when 'signup' then 'clone' when 'purchase' then 'archive' when 'click' then 'dependency'
                    when 'view' then 'push' else 'upload' end as operation,
               case when event_type = 'error' then event_id % 4 end as retry_attempt,
               case when event_type = 'error' then case event_id % 5 when 0 then 'AuthenticationError' when 1 then 'StorageError'
                    when 2 then 'ValueError' else 'NetworkError' end end as error_type,
               event_id % 10 <> 3 as retryable,
               'sync-' || replace(substr(cast(ts as varchar(30)), 1, 10), '-', '') || '-' || cast(user_id % 3 as varchar(10)) as session_id
        from {events}""",
    "v_log_lines": """
        select event_id, case when event_id % 31 = 0 then '{{"timestamp": ' when event_id % 37 = 0 then '[1, 2]' else
               '{{"timestamp": "' || replace(substr(cast(ts as varchar(30)), 1, 19), ' ', 'T') ||
               case when event_id % 2 = 0 then '.250000' else '' end || '", "level": "' || level || '", "logger": "' || logger ||
               '", "message": "' || message || '", "filename": "engine.py", "lineno": ' || cast(user_id as varchar(20)) ||
               ', "repository": "' || repository || '", "commits_synced": ' ||
               case when event_id % 41 = 0 then '"many"' else cast(commits_synced as varchar(10)) end || ', "odd key": true}}' end as value
        from {v_log}""",
    "v_gauges": """
        select event_id, ts, event_type as archive_type, cast(round(value * 100) as bigint) as size_bytes from {events}""",
    "v_alert_rows": """
        select event_id, event_type, case when event_type = 'click' then value > 1 end as checksum_verification,
               case when event_type = 'view' then value * 100 end as archive_size_mb,
               value * 40 as operation_duration_seconds from {events}""",
    "v_notices": """
        select user_id as url, event_id * 2 as seq, ts, 'started' as state, event_id as operation_id from {events}
        union all
        select user_id, event_id * 2 + 1, ts + interval 30 second,
               case when event_type = 'error' then 'failed' else 'completed' end, event_id
        from {events} where event_type <> 'view'""",
    "v_sessions": """
        select session_id, min(user_id) as outer_user, max(level) as environment from {v_log} group by session_id""",
    "v_operations": """
        select event_id as operation_id, case when event_type = 'error' then 'oncall' end as environment from {events}""",
}


def references(sql: str) -> list[str]:
    """Names in braces, in order of appearance."""
    found = [name for _, name, _, _ in string.Formatter().parse(sql) if name]
    return list(dict.fromkeys(found))


class Source:
    """Supplied tables and derived views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._schemas = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        path = f"{self.folder}/{name}.parquet"
        if name not in self._schemas:
            # Read the file footers for the schema once, not once per use of the table.
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def spread(self, name: str) -> DataFrame:
        """The rows dealt to all cores, for work that is heavy per row: a supplied table is one file of one row group."""
        return self[name].repartition(self.spark.sparkContext.defaultParallelism)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: self[name] for name in references(text)})


def standalone_sql(text: str) -> str:
    """The same query with every view it needs as a common table expression."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for inner in references(VIEWS[name]):
                visit(inner)
            ordered.append(name)

    for name in references(text):
        visit(name)

    def plain(sql: str) -> str:
        return sql.format(**{name: name for name in references(sql)})

    body = plain(text).strip()
    if not ordered:
        return body
    views = ",\n".join(f"{name} as ({plain(VIEWS[name]).strip()})" for name in ordered)
    if body.lower().startswith("with recursive "):
        return f"with recursive {views},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {views},\n{body[len('with '):]}"
    return f"with {views}\n{body}"
