"""Text corpora as lines, with the discovery filters that need no content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directories and file names that are never read.
EXCLUDED_DIRS = ("node_modules", "vendor", "dist", "build", "target", ".git", ".venv", "venv", "__pycache__", ".idea")
EXCLUDED_SUFFIXES = (".min.js", ".map", ".lock", ".sum", "_pb2.py", ".pb.go", ".d.ts", "-lock.json", "-lock.yaml")
MANIFESTS = {
    "package.json": "npm",
    "go.mod": "go",
    "pyproject.toml": "python",
    "setup.py": "python",
    "requirements.txt": "python",
    "pom.xml": "maven",
    "build.gradle": "gradle",
    "build.gradle.kts": "gradle",
    "settings.gradle": "gradle",
    "settings.gradle.kts": "gradle",
    "Cargo.toml": "cargo",
    "Gemfile": "ruby",
    "composer.json": "php",
    "mix.exs": "elixir",
    "Chart.yaml": "helm",
    "Dockerfile": "docker",
    "docker-compose.yml": "compose",
    "docker-compose.yaml": "compose",
    "compose.yaml": "compose",
    "application.yml": "spring",
    "application.yaml": "spring",
    "application.properties": "spring",
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_excluded(path: Column, output_dir: str | None = None) -> Column:
    """Folders and files that are never swept, rendered bundles among them."""
    dirs = "|".join(d.replace(".", r"\.") for d in (*EXCLUDED_DIRS, *([output_dir] if output_dir else [])))
    suffixes = "|".join(s.replace(".", r"\.") for s in EXCLUDED_SUFFIXES)
    return path.rlike(rf"(^|/)({dirs})/") | path.rlike(rf"({suffixes})$") | path.rlike(r"(^|/)releases?/[^/]+\.ya?ml$")


def is_test(path: Column) -> Column:
    """Test code gives no edges, but may resolve values."""
    return path.rlike(r"(^|/)(tests?|__tests__|spec|testdata|fixtures)/") | path.rlike(r"(_test\.go|\.(test|spec)\.[jt]sx?|(^|/)test_[^/]*\.py|Tests?\.(java|kt|cs))$")


def read_repository(spark: SparkSession, root: str, output_dir: str | None = None) -> DataFrame:
    """``path, text`` of every text file below ``root``, exclusions applied before the content is read."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.url_decode(F.regexp_replace("uri", r"^[a-z]+:/*", "/")), "^" + base.replace(".", r"\.") + "/", "")
    files = raw.withColumn("path", path)
    return files.filter(~is_excluded(F.col("path"), output_dir)).select("path", "text")


def split_lines(files: DataFrame, after: int = 0) -> DataFrame:
    """``path, line, text`` with lines from 1; a line break at the end opens no line.

    With ``after`` each line has the next ones of its file beside it, which saves joins to readers of many hits.
    """
    pieces = F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)
    some = files.filter("text is not null and text <> ''")
    if not after:
        return some.select("path", F.posexplode(pieces).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")
    each = some.select("path", pieces.alias("pieces")).select("path", "pieces", F.posexplode("pieces").alias("at", "text"))
    return each.select("path", (F.col("at") + 1).alias("line"), "text", F.slice("pieces", F.col("at") + 2, F.lit(after)).alias("after"))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.max("line").alias("n_lines"))


def manifests(files: DataFrame) -> DataFrame:
    """Build and deploy manifests: ``path, ecosystem``."""
    kinds = F.create_map(*(F.lit(x) for kv in MANIFESTS.items() for x in kv))
    name = file_name(F.col("path"))
    kind = F.coalesce(F.element_at(kinds, name), F.when(name.rlike(r"\.csproj$"), "dotnet"), F.when(name.rlike(r"^(docker-)?compose.*\.ya?ml$"), "compose"))
    return files.select("path", kind.alias("ecosystem")).filter("ecosystem is not null").distinct()


def is_manifest(path: Column) -> Column:
    name = file_name(path)
    return name.isin(*MANIFESTS) | name.rlike(r"\.csproj$|^(docker-)?compose.*\.ya?ml$")


def workloads(lines: DataFrame) -> DataFrame:
    """Kubernetes manifests by kind: ``path, line, kind``."""
    kind = F.regexp_extract("text", r"^kind:\s*(Deployment|StatefulSet|Service)\s*$", 1)
    return lines.filter(F.col("path").rlike(r"\.ya?ml$")).select("path", "line", kind.alias("kind")).filter("kind <> ''")


def with_after(lines: DataFrame, n: int = 2) -> DataFrame:
    """Lines with the next ``n`` lines of their file as ``after``."""
    w = Window.partitionBy("path").orderBy("line")
    following = F.array_compact(F.array(*(F.lead("text", k).over(w) for k in range(1, n + 1))))
    return lines.withColumn("after", following)


def after_hits(lines: DataFrame, hits: DataFrame, n: int = 2) -> DataFrame:
    """Hits (any columns with ``path, line``) with the next ``n`` lines of their file as ``after``.

    The numbers of the wanted lines meet the lines in an equi-join, so only hits are
    gathered and no file is sorted.  Hits of lines that were split with ``after`` have theirs.
    """
    if "after" in hits.columns:
        return hits.withColumn("after", F.slice("after", 1, n))
    wanted = hits.select("path", "line").distinct().select("path", F.col("line").alias("hit"), F.explode(F.sequence(F.col("line") + 1, F.col("line") + n)).alias("line"))
    near = wanted.join(lines.select("path", "line", "text"), ["path", "line"]).groupBy("path", F.col("hit").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("line").alias("l"), "text"))), lambda x: x["text"]).alias("after"))
    return hits.join(near, ["path", "line"], "left").withColumn("after", F.coalesce("after", F.array().cast("array<string>")))


def window_around(lines: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The lines within ``k`` of each hit, joined on (path, line) after the offsets are spread out."""
    wanted = hits.select("path", F.col("line").alias("hit")).distinct().select("path", "hit", F.explode(F.sequence(F.col("hit") - k, F.col("hit") + k)).alias("line"))
    return lines.join(wanted, ["path", "line"])


def enclosing_key(lines: DataFrame) -> DataFrame:
    """YAML lines with the keys of the two levels around them, carried down by line order."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda indent: F.regexp_extract("text", rf"^{' ' * indent}([A-Za-z0-9_.-]+):", 1)
    top = F.when(at(0) != "", at(0))
    second = F.when(at(2) != "", at(2)).when(at(0) != "", F.lit(""))
    return lines.withColumn("section", F.last(top, ignorenulls=True).over(w)).withColumn("entry", F.nullif(F.last(second, ignorenulls=True).over(w), F.lit("")))


def compose_services(lines: DataFrame) -> DataFrame:
    """Deployables of compose files: ``path, name, line, image, build, environment, depends_on``."""
    inside = enclosing_key(lines.filter(file_name(F.col("path")).rlike(r"^(docker-)?compose.*\.ya?ml$"))).filter("section = 'services' and entry is not null")
    value = lambda key: F.regexp_extract("text", rf"^    {key}:\s*[\"']?([^\"'#]+?)[\"']?\s*$", 1)
    item = F.regexp_extract("text", r"^      - \"?([A-Za-z0-9_.-]+)\"?\s*$", 1)
    env_map = F.struct(F.regexp_extract("text", r"^      ([A-Z][A-Z0-9_]*):", 1).alias("var"), F.regexp_extract("text", r"^      [A-Z][A-Z0-9_]*:\s*[\"']?(.*?)[\"']?\s*$", 1).alias("value"), "line")
    env_list = F.struct(F.regexp_extract("text", r"^      - \"?([A-Z][A-Z0-9_]*)=", 1).alias("var"), F.regexp_extract("text", r"^      - \"?[A-Z][A-Z0-9_]*=(.*?)\"?\s*$", 1).alias("value"), "line")
    return inside.groupBy("path", F.col("entry").alias("name")).agg(
        F.min("line").alias("line"),
        F.max(F.when(value("image") != "", value("image"))).alias("image"),
        F.max(F.when(value("build") != "", value("build"))).alias("build"),
        F.array_sort(F.concat(F.collect_list(F.when(env_map["var"] != "", env_map)), F.collect_list(F.when(env_list["var"] != "", env_list)))).alias("environment"),
        F.array_sort(F.collect_list(F.when((item != "") & ~F.col("text").contains("="), item))).alias("depends_on"),
    )


def config_values(lines: DataFrame) -> DataFrame:
    """Configuration keys: ``path, line, key, value`` from yml, yaml, properties, env, tf, toml and json files."""
    files = lines.filter(F.col("path").rlike(r"(\.(ya?ml|properties|env|tf|tfvars|toml|json)|(^|/)\.env[^/]*)$"))
    pair = r"^\s*\"?([A-Za-z_][A-Za-z0-9_.-]*)\"?\s*[:=]\s*[\"']?([^\"'#,]+?)[\"']?,?\s*$"
    return files.select("path", "line", F.regexp_extract("text", pair, 1).alias("key"), F.regexp_extract("text", pair, 2).alias("value")).filter("key <> '' and value <> ''")


def address_hits(lines: DataFrame) -> DataFrame:
    """Variables that name an address, channel or data source: ``path, line, var, value``.

    A value that stands on the line below (``name:`` and ``value:`` of a manifest) counts.
    """
    name = r"\b([A-Z][A-Z0-9_]*(?:ADDR|ADDRESS|URL|URI|HOST|HOSTNAME|ENDPOINT|DSN|BROKERS?|TOPIC|QUEUE))\b"
    value = r"[A-Z0-9_]+[\"']?\s*[:=,]\s*[\"']?([^\"'\s,)]+)"
    found = after_hits(lines, lines.withColumn("var", F.regexp_extract("text", name, 1)).filter("var <> ''"), 1)
    below = F.regexp_extract(F.coalesce(F.get("after", F.lit(0)), F.lit("")), r"^\s*value:\s*[\"']?([^\"'\s]+)", 1)
    here = F.regexp_extract("text", value, 1)
    return found.select("path", "line", "var", F.when(here != "", here).otherwise(below).alias("value"))


def api_hosts(lines: DataFrame) -> DataFrame:
    """Hosts that API descriptions name as their servers: ``path, line, host``."""
    from ..functions.text import host

    yaml = lines.filter(F.col("path").rlike(r"\.ya?ml$"))
    inside = enclosing_key(yaml).filter("section = 'servers'")
    return inside.select("path", "line", host(F.regexp_extract("text", r"url:\s*[\"']?(\S+?)[\"']?\s*$", 1)).alias("host")).filter("host is not null")


def contracts(lines: DataFrame) -> DataFrame:
    """Services declared in .proto files, copies counted once: ``name, path, line`` of the shallowest."""
    found = lines.filter(F.col("path").endswith(".proto")).select(F.regexp_extract("text", r"^\s*service\s+([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name"), "path", "line").filter("name <> ''")
    return found.groupBy("name").agg(F.min_by(F.struct("path", "line"), F.struct(F.size(F.split("path", "/")), "path", "line")).alias("p")).select("name", "p.path", "p.line")


def routes(lines: DataFrame) -> DataFrame:
    """Server routes: ``path, line, method, template``; they serve path matching and are never edges."""
    from ..functions import text as T

    spring = r"@(Get|Post|Put|Delete|Patch)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]+)\""
    express = r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*[\"'`]([^\"'`]+)"
    flask = r"@[A-Za-z_.]+\.(route|get|post|put|delete|patch)\(\s*[\"']([^\"']+)"
    go = r"\bHandleFunc\(\s*\"(?:(GET|POST|PUT|DELETE|PATCH) )?([^\"]+)\""
    openapi = r"^  (/[^:]*):\s*$"
    some = lines.filter(T.may_match(F.col("text"), spring, express, flask, go) | F.col("path").rlike(r"\.ya?ml$"))
    method, path = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in (go, flask, express, spring):
        hit = F.col("text").rlike(p)
        verb = F.upper(F.regexp_extract("text", p, 1))
        method = F.when(hit, F.when(verb.isin("", "ROUTE"), "ANY").otherwise(verb)).otherwise(method)
        path = F.when(hit, F.regexp_extract("text", p, 2)).otherwise(path)
    spec = F.col("path").rlike(r"\.ya?ml$") & F.col("text").rlike(openapi)
    method, path = F.when(spec, "ANY").otherwise(method), F.when(spec, F.regexp_extract("text", openapi, 1)).otherwise(path)
    return some.select("path", "line", method.alias("method"), T.template(path).alias("template")).filter("template is not null")


def owners(paths: DataFrame, services: DataFrame) -> DataFrame:
    """Each path with the service of the deepest root above it: ``path, service_id, root``.

    Paths are spread out to their prefixes, so this is an equi-join and an
    aggregate, not a comparison of every path with every root.
    """
    from ..functions.text import prefixes

    spread = paths.select("path").distinct().select("path", F.explode(prefixes(F.col("path"))).alias("root"))
    joined = spread.join(services.select("service_id", F.col("root_path").alias("root")), "root")
    best = joined.groupBy("path").agg(F.max_by(F.struct("service_id", "root"), F.struct(F.char_length("root"), "service_id")).alias("o"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", "o.service_id", "o.root")


def deployables(lines: DataFrame) -> DataFrame:
    """What compose files and Kubernetes manifests run: ``name, path, line, image, build``."""
    compose = compose_services(lines).select("name", "path", "line", "image", "build")
    kinds = workloads(lines).select("path").distinct()
    yaml = lines.join(kinds, "path", "left_semi")
    named = yaml.withColumn("name", F.regexp_extract("text", r"^  name:\s*[\"']?([A-Za-z0-9.-]+)", 1)).filter("name <> ''")
    first = named.groupBy("path", "name").agg(F.min("line").alias("line"))
    image = yaml.withColumn("image", F.regexp_extract("text", r"^\s+(?:- )?image:\s*[\"']?([^\"'\s]+)", 1)).filter("image <> ''").groupBy("path").agg(F.min("image").alias("image"))
    kube = first.join(image, "path", "left").select("name", "path", "line", "image", F.lit(None).cast("string").alias("build"))
    return compose.unionByName(kube)


def declared_units(trees: DataFrame) -> DataFrame:
    """What compose files and Kubernetes manifests run, from key_trees(): ``name, path, line, image, build``.

    However the files are indented; each document of a manifest is a workload of its own.
    """
    compose = trees.filter(file_name(F.col("path")).rlike(r"^(docker-)?compose.*\.ya?ml$") & F.col("key").startswith("services."))
    of = lambda *keys: F.max(F.when(F.col("rest").isin(*keys), F.col("value")))
    c = compose.withColumn("name", F.regexp_extract("key", r"^services\.([^.]+)", 1)).withColumn("rest", F.regexp_extract("key", r"^services\.[^.]+\.(.*)$", 1))
    c = c.groupBy("path", "name").agg(F.min("line").alias("line"), of("image").alias("image"), of("build", "build.context").alias("build"))
    manifests_ = trees.filter(F.col("path").rlike(r"\.ya?ml$"))
    at = lambda key: F.max(F.when(F.col("key") == key, F.struct("line", "value")))
    k = manifests_.groupBy("path", "doc").agg(at("kind").alias("kind"), at("metadata.name").alias("name"), F.min(F.when(F.col("key").rlike(r"(^|\.)containers\.[0-9]+\.image$"), F.struct("line", "value"))).alias("image"))
    k = k.filter(F.col("kind.value").isin("Deployment", "StatefulSet", "Service", "DaemonSet") & F.col("name").isNotNull())
    return c.select("name", "path", "line", "image", "build").unionByName(k.select("name.value", "path", "name.line", "image.value").toDF("name", "path", "line", "image").withColumn("build", F.lit(None).cast("string")))


def deployable_hosts(units: DataFrame) -> DataFrame:
    """Host names of deployables: ``host, id, kind``; images of stores are stores, brokers are not drawn."""
    from ..functions.text import is_broker, store_kind

    kept = units.filter(~F.coalesce(is_broker(F.col("image")), F.lit(False)))
    return kept.groupBy(F.col("name").alias("host")).agg(F.coalesce(F.max(store_kind(F.col("image"))), F.lit("svc")).alias("kind")).select("host", F.col("host").alias("id"), "kind")


def named_by_deployment(services: DataFrame, units: DataFrame) -> DataFrame:
    """Services under the name of the deployable that builds their folder, or is called like it.

    ``services`` are those of service_names(): a build name never beats the
    deployable's, and a folder that is deployed without a manifest name is a service too.
    """
    build = F.regexp_replace(F.regexp_replace(F.coalesce("build", F.lit("")), r"^\./", ""), r"/$", "")
    from_ = F.when(build == "", F.lit("")).otherwise(F.concat(F.regexp_replace("path", r"[^/]+$", ""), build))
    by_build = units.select(F.col("name").alias("unit"), from_.alias("root_path")).filter("root_path <> ''").groupBy("root_path").agg(F.min("unit").alias("built"))
    by_name = units.select(F.col("name").alias("folder")).distinct().withColumn("called", F.col("folder"))
    named = services.join(by_build, "root_path", "full_outer").withColumn("folder", F.substring_index("root_path", "/", -1)).join(by_name, "folder", "left")
    return named.withColumn("service_id", F.coalesce("built", "called", "service_id", "folder")).select(*services.columns)


def service_names(lines: DataFrame) -> DataFrame:
    """Services by manifest: ``service_id, root_path, tech, path, line``, the best-ranked name of each directory."""
    from ..functions.text import last_segment, without_scope

    name = file_name(F.col("path"))
    cases = (
        (1, "spring", name.rlike(r"^application\.(ya?ml|properties)$"), r"^\s*(?:spring\.application\.)?name\s*[:=]\s*([A-Za-z0-9._-]+)"),
        (2, "npm", name == "package.json", r"^\s*\"name\"\s*:\s*\"([^\"]+)\""),
        (3, "go", name == "go.mod", r"^module\s+(\S+)"),
        (4, "python", name == "pyproject.toml", r"^name\s*=\s*\"([^\"]+)\""),
        (5, "cargo", name == "Cargo.toml", r"^name\s*=\s*\"([^\"]+)\""),
        (6, "maven", name == "pom.xml", r"^\s*<artifactId>([^<]+)</artifactId>"),
        (7, "gradle", name.rlike(r"^settings\.gradle(\.kts)?$"), r"rootProject\.name\s*=\s*[\"']([^\"']+)"),
        (8, "helm", name == "Chart.yaml", r"^name:\s*(\S+)"),
    )
    rank = tech = id_ = F.lit(None)
    for r, t, where, pattern in cases:
        hit = where & F.col("text").rlike(pattern)
        rank, tech, id_ = F.when(hit, r).otherwise(rank), F.when(hit, F.lit(t)).otherwise(tech), F.when(hit, F.regexp_extract("text", pattern, 1)).otherwise(id_)
    named = lines.filter(reduce(lambda a, b: a | b, (where for _, _, where, _ in cases)))
    found = named.select("path", "line", rank.alias("rank"), tech.alias("tech"), last_segment(without_scope(id_)).alias("service_id")).filter("rank is not null")
    # a Spring module's root is the folder above src/main/resources
    root = F.regexp_replace("path", r"(/src/main/resources)?/?[^/]+$", "")
    best = found.withColumn("root_path", root).groupBy("root_path").agg(F.min_by(F.struct("service_id", "tech", "path", "line"), F.struct("rank", "line")).alias("s"))
    return best.select("s.service_id", "root_path", "s.tech", "s.path", "s.line")


def without_wrappers(services: DataFrame, files: DataFrame) -> DataFrame:
    """Services whose root owns code beyond its manifests; workspace roots go."""
    owned = owners(files.join(manifests(files), "path", "left_anti"), services).filter("service_id is not null").select("service_id").distinct()
    return services.join(owned, "service_id", "left_semi")
