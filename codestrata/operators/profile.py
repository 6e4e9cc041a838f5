"""Technology stack of each project, from its listing and package.json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_number

PACKAGE = "name string, workspaces string, dependencies map<string,string>, devDependencies map<string,string>"
# Paths whose existence counts.
PROBES = (
    "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "app", "src/app", "pages", "src/pages", "pnpm-workspace.yaml", "turbo.json", "lerna.json", "nx.json",
    "tsconfig.json", "prisma", "src", "__tests__", "tests", "test", "public", "actions", "src/actions",
)
# Labels by dependency, after the framework and router labels.
DEPENDENCY_LABELS = (("drizzle-orm", "Drizzle"), ("@trpc/server", "tRPC"), ("tailwindcss", "Tailwind"), ("next-auth", "NextAuth"), ("@clerk/nextjs", "Clerk"))


def _some(value: Column) -> Column:
    """Present and not empty."""
    return F.coalesce(value != "", F.lit(False))


def detect_stack(entries: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per project: name, labels (in order), pm and the flags."""
    has = {p: F.bool_or(F.col("rel_path") == p).alias(p) for p in PROBES}
    root = F.max(F.when(F.col("rel_path") == "", F.col("name"))).alias("root_name")
    seen = entries.groupBy("project_id").agg(root, F.struct(*has.values()).alias("has"))
    package = configs.where(F.col("name") == "package.json").groupBy("project_id").agg(F.min("content").alias("content"))
    package = package.select("project_id", F.from_json("content", PACKAGE).alias("pkg"))
    rows = seen.join(package, "project_id", "left")
    on = lambda p: F.coalesce(F.col("has").getField(p), F.lit(False))
    dep = lambda d: F.coalesce(F.try_element_at("pkg.devDependencies", F.lit(d)), F.try_element_at("pkg.dependencies", F.lit(d)))
    app, pages = on("app") | on("src/app"), on("pages") | on("src/pages")
    prisma = _some(dep("@prisma/client")) | _some(dep("prisma")) | on("prisma")
    workspaces = F.coalesce(~F.col("pkg.workspaces").isin("", "false", "0", "null"), F.lit(False))
    mono = workspaces | on("pnpm-workspace.yaml") | on("turbo.json") | on("lerna.json") | on("nx.json")
    labels = [
        F.when(_some(dep("next")), F.concat(F.lit("Next.js"), first_number(dep("next")))).when(_some(dep("react")), F.concat(F.lit("React"), first_number(dep("react")))),
        F.when(_some(dep("typescript")) | on("tsconfig.json"), "TypeScript"),
        F.when(app, "App Router").when(pages, "Pages Router"),
        F.when(prisma, "Prisma"),
        *[F.when(_some(dep(d)), label) for d, label in DEPENDENCY_LABELS],
        F.when(mono, "Monorepo"),
    ]
    return rows.select(
        "project_id", F.coalesce("pkg.name", "root_name").alias("name"), F.array_compact(F.array(*labels)).alias("labels"),
        F.when(on("pnpm-lock.yaml"), "pnpm").when(on("yarn.lock"), "yarn").when(on("bun.lockb"), "bun").otherwise("npm").alias("pm"),
        app.alias("app_router"), pages.alias("pages_router"), mono.alias("is_monorepo"), on("src").alias("has_src"), prisma.alias("has_prisma"),
        (on("__tests__") | on("tests") | on("test")).alias("has_tests"),
    )
