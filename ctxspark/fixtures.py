"""Small source files of our own and what parsing them must give."""

from __future__ import annotations

FILES: dict[str, tuple[str, str]] = {
    "db/schema.sql": (
        "sql",
        """-- orders
CREATE TABLE IF NOT EXISTS shop.orders (id int);
create or replace view [dbo].[open_orders] as select 1;
CREATE PROCEDURE close_order AS BEGIN END;
create unique_thing x;
CREATE INDEX ix_orders ON shop.orders (id);
""",
    ),
    "app/Shop.cs": (
        "csharp",
        """using System.Linq;
namespace Shop.Core;

public abstract class Basket : Entity, IBasket
{
    // class Ghost : Nothing
    public Basket(int size) { Size = size; }
    public async Task<int> Total(string currency) { if (x) { return 1; } return 2; }
}
interface IBasket : IReadable { }
public enum State { Open, Closed }
""",
    ),
    "app/Shop.csproj": (
        "dotnet",
        """<Project>
  <TargetFramework>net8.0</TargetFramework>
  <PackageReference Include="Polly" Version="8" />
  <ProjectReference Include="..\\lib\\Lib.csproj" />
</Project>
""",
    ),
    "web/page.aspx": (
        "aspnet",
        """<%@ Page Language="C#" Inherits="Shop.Page" %>
<script runat="server">
public Sub Load()
private int Count(int a) { return a; }
</script>
""",
    ),
    "tool/run.py": (
        "python",
        '''import os
from a.b import c as d
LIMIT = 10
type Pair = tuple

class Runner(Base, mixins.Loud):
    """Runs."""
    RATE: int = 2

    def __init__(self):
        self.x = call(Arg)

    @property
    def speed(self):
        return 1

@cached
async def main():
    pass
''',
    ),
    "app/Models/Post.php": (
        "php",
        """<?php
namespace App\\Models;

use App\\Traits\\Likes as L;

/**
 * A post.
 */
final class Post extends Model implements Likeable
{
    use HasTags, SoftDeletes;

    protected const MAX_TITLE = 80;
    private ?string $title = "class Fake {";

    public function author() { return $this->belongsTo(User::class); }
    private static function make(array $a): self
    {
        return new self();
    }
}

function helper($x) { return $x; }
""",
    ),
    "web/Cart.tsx": (
        "tsx",
        """import { useQuery } from "react-query";
export interface Item extends Base<string> { id: number }
export type Id = string | number;
enum Color { Red }
export class Store extends Service<Item> implements Readable {
  private load(id: Id): void { if (id) { go(); } }
  constructor() { super(); }
}
export function Cart() {
  const q = useQuery({ queryFn: loadCart });
  return <Row />;
}
export const useCart = () => useQuery({ queryFn: loadCart });
const add = (a: number, b: number): number => {
  return a + b;
};
""",
    ),
}

# name, kind, first line, last line, parent by file
EXPECTED: dict[str, list[tuple[str, str, int, int, str | None]]] = {
    "db/schema.sql": [("orders", "table", 2, 2, None), ("open_orders", "view", 3, 3, None), ("close_order", "stored_procedure", 4, 4, None), ("ix_orders", "unknown", 6, 6, None)],
    "app/Shop.cs": [("Shop.Core", "namespace", 2, 2, None), ("Linq", "import", 1, 1, None), ("Basket", "abstract_class", 4, 4, None), ("IBasket", "interface", 10, 10, None), ("State", "enum", 11, 11, None), ("Basket", "constructor", 7, 7, "Basket"), ("Total", "method", 8, 8, "Basket")],
    "app/Shop.csproj": [("net8.0", "constant", 2, 2, None), ("Polly", "package", 3, 3, None), ("Lib.csproj", "project", 4, 4, None)],
    "web/page.aspx": [("Shop.Page", "class", 1, 1, None), ("Load", "method", 3, 3, None), ("Count", "method", 4, 4, None)],
    "tool/run.py": [("LIMIT", "constant", 3, 3, None), ("Pair", "type_alias", 4, 4, None), ("Runner", "class", 6, 15, None), ("RATE", "constant", 8, 8, "Runner"), ("__init__", "constructor", 10, 11, "Runner"), ("speed", "method", 13, 15, "Runner"), ("main", "function", 17, 19, None)],
    "app/Models/Post.php": [("Likes", "import", 4, 4, None), ("Post", "model", 9, 21, None), ("MAX_TITLE", "constant", 13, 13, "Post"), ("title", "property", 14, 14, "Post"), ("author", "method", 16, 16, "Post"), ("make", "method", 17, 20, "Post"), ("helper", "function", 23, 23, None)],
    "web/Cart.tsx": [("Item", "interface", 2, 2, None), ("Id", "type_alias", 3, 3, None), ("Color", "enum", 4, 4, None), ("Store", "class", 5, 8, None), ("load", "method", 6, 6, "Store"), ("constructor", "constructor", 7, 7, "Store"), ("Cart", "react_component", 9, 12, None), ("useCart", "hook", 13, 13, None), ("add", "arrow_function", 14, 16, None)],
}
# target, kind of the relationships by file
EXPECTED_RELATIONSHIPS: dict[str, list[tuple[str, str]]] = {
    "db/schema.sql": [],
    "app/Shop.cs": [("Entity", "extends"), ("IBasket", "implements"), ("IReadable", "implements")],
    "app/Shop.csproj": [],
    "web/page.aspx": [],
    "tool/run.py": [("import os", "imports"), ("from a.b import c as d", "imports"), ("Base", "extends"), ("mixins.Loud", "extends")],
    "app/Models/Post.php": [("App\\Traits\\Likes", "imports"), ("Model", "extends"), ("Likeable", "implements"), ("HasTags", "uses"), ("SoftDeletes", "uses"), ("User", "belongs_to")],
    "web/Cart.tsx": [("react-query", "imports"), ("Base", "extends"), ("Service", "extends"), ("Readable", "implements"), ("useQuery", "queries"), ("useQuery", "queries")],
}
