"""A small source tree as literal rows, for operators that read code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import kind

FILES: dict[str, str] = {
    "src/users/users.controller.ts": "import { Controller, Get as Fetch } from '@nestjs/common';\nimport { UsersService } from './users.service';\nimport type { User } from '../shared/types';\n\n@Controller('users')\nexport class UsersController extends BaseController implements Routed, Named<string> {\n  @Get()\n  list() { return this.service.findAll(helper(1)); }\n  @Post('/create/')\n  // @Delete('nope')\n  make(u: User): User { return newUser(u); }\n}\nclass BaseController {}\n",
    "src/users/users.service.ts": "import { UsersRepository } from './users.repository';\nimport React, { useState, type FC } from 'react';\nimport * as path from 'path';\nexport class UsersService {\n  findAll(x: number) { return new UsersRepository().all(); }\n}\nexport const helper = (n: number) => n; // Foo Bar(\nconst text = \"if (Quoted) { call( }\";\n",
    "src/users/users.repository.ts": "import { Entity } from './user.entity';\nexport class UsersRepository {\n  all(): Entity[] { return query(`select ${Entity}`); }\n}\nfunction query(sql: string) { return []; }\n",
    "src/users/user.entity.ts": "export interface Named<T> { name: T }\nexport interface Entity extends Named<string>, Dated {\n  id: number;\n}\ninterface Dated { at: Date }\nexport type Id = number;\nexport enum Color { Red }\nexport const enum Tone { Low }\nlet counter: number = 0;\n",
    "src/users/users.module.ts": "import './users.controller';\nexport default class UsersModule {}\n",
    "src/users/users.service.test.ts": "import { UsersService } from './users.service';\ndescribe('x', () => { new UsersService(); });\n",
    "src/shared/types.ts": "export interface User { id: Id }\nexport type Id = string;\n",
    "src/billing/billing.service.ts": "import {\n  UsersService,\n} from '../users/users.service';\nimport lodash from 'lodash/fp';\nexport abstract class BillingService<T> extends UsersService {}\n",
    "src/billing/routes/invoices.router.ts": "const router = Router();\nrouter.get('/invoices', list); router.post(\"/invoices/:id\", make);\nimport { BillingService } from '../billing.service';\nexport async function list() { return BillingService; }\n",
    "apps/shop/main.py": "from fastapi import FastAPI\nimport os, sys\nfrom .models import Item\napp = FastAPI()\n@app.get('/items')\ndef items():\n    return load_items()\n@router.post(\"/items/{id}\")\ndef _hidden(x):\n    return Item(x)\n",
    "apps/shop/models.py": "class Base:\n    pass\nclass Item(Base, Generic[T]):\n    def save(self):\n        return print('saved')\nclass _Private(Base):\n    pass\n",
    "cmd/tool/main.go": "package main\nimport (\n\t\"fmt\"\n\tlog \"example/log\"\n)\nimport \"os\"\nfunc main() { fmt.Println() }\nfunc (s *Server) handle(x int) {}\ntype Server struct {\n}\ntype reader interface {}\n",
    "native/lib.rs": "pub fn open<T>(x: T) {}\nasync fn hidden() {}\npub struct Handle;\nenum Mode { A }\n",
    "java/Shop.java": "package shop;\npublic class Shop extends Store<Item> implements Open, Closed {\n  public static List items(int n) { return null; }\n  private int count() { return 0; }\n}\n",
    "web/app/(marketing)/about/page.tsx": "export default function About() { return null; }\n",
    "web/app/api/users/route.ts": "export async function GET() {}\nexport const POST = () => {};\nexport async function GET(x) {}\n",
    "web/pages/index.tsx": "export default function Home() { return null; }\n",
    "web/pages/_app.tsx": "export default function App() {}\n",
    "web/pages/api/orders/[id].ts": "export default function handler() {}\n",
    "web/features/cart/cart.store.ts": "import { total } from './totals';\nexport const store = total;\n",
    "web/features/cart/totals/index.ts": "export function total(a) { return a; }\n",
    "tools/commands/sync.ts": "program.command('sync').command('pull-all <x>');\n",
    "packages/core/src/index.ts": "export * from './util';\nexport const version = '1';\n",
    "packages/core/package.json": '{"name": "@demo/core"}',
    "packages/app/src/app.ts": "import { version } from '@demo/core';\nimport { deep } from '@lib/deep';\nexport const shown = version;\n",
    "packages/app/package.json": '{"name": "app", "private": true}',
    "lib/deep.ts": "export const deep = 1;\n",
    "docs/skills/users.md": "---\nname: users-skill\ndescription: \"How users work\"\ndomains: [packages/core, 'src']\nalwaysApply: false\n---\n# Users\n",
    "docs/skills/domain-packages-app.md": "---\ndescription: plain\nalwaysApply: true\n---\ntext\n",
    "docs/readme.md": "# Read me\n",
}

#: Path aliases as a compiler configuration states them, with comments.
CONFIG = '{\n  // comment\n  "compilerOptions": { "baseUrl": ".", "paths": { "@lib/*": ["lib/*"], /* more */ "@exact": ["src/index.ts"], }, },\n}'


#: Documents of the tables for each copy of the tree, so that the source tree grows with them.
DOCUMENTS_PER_TREE = 20
#: What tells the copies apart: in paths and contents, these are followed by the copy's number.
MARKS = ["users", "shared/types", "billing", "apps/shop", "cmd/tool", "native", "java/", "web", "tools", "packages/core", "demo/core", "packages/app", '"app', "packages-app", "lib", "readme"]

#: Stands for a copy's number in the tree that the copies are made from.
NUMBER = "\x01"


def code_files(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """(path, content, kind): the tree, with sf_dir as many copies of it as its documents ask for.

    Copy 0 is the tree as it stands. Names of folders and packages differ from copy
    to copy, names of symbols don't.
    """
    if sf_dir is None:
        return spark.createDataFrame(list(FILES.items()), "path string, content string").withColumn("kind", kind(F.col("path")))
    files = spark.createDataFrame([(_marked(p), _marked(c)) for p, c in FILES.items()], "path string, content string")
    trees = max(1, spark.read.parquet(f"{sf_dir}/documents.parquet").count() // DOCUMENTS_PER_TREE)
    number = F.when(F.col("id") == 0, "").otherwise(F.col("id").cast("string"))
    numbered = lambda c: F.replace(c, F.lit(NUMBER), number).alias(c)
    files = spark.range(trees).crossJoin(F.broadcast(files)).select(numbered("path"), numbered("content"))
    return files.withColumn("kind", kind(F.col("path")))


def _marked(text: str) -> str:
    """text with NUMBER after each mark; as no mark holds a digit or NUMBER, one replacement per copy does the rest."""
    for mark in MARKS:
        text = text.replace(mark, mark + NUMBER)
    return text


def sql_values() -> str:
    """The same rows as a SQL relation files(path, content)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def marked(c: str) -> str:
        out = c
        for mark in MARKS:
            out = f"replace({out}, {q(mark)}, {q(mark)} || k)"
        return f"case when k = 0 then {c} else {out} end"

    values = "(values " + ",\n".join(f"({q(p)}, {q(c)})" for p, c in FILES.items()) + ") as f(path, content)"
    trees = f"(select unnest(range(0, greatest(1, (select count(*) from documents) // {DOCUMENTS_PER_TREE}))) as k) as trees"
    return f"(select {marked('path')} as path, {marked('content')} as content from {values}, {trees}) as files"
