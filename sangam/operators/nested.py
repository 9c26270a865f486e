"""Problem 2: nested records as flat tables, by Merkle identities of their objects.

Each object is canonicalised bottom-up: its scalar fields as sorted JSON, each object below it replaced by that object's
hash. Equal hashes mean equal subtrees, so an object is stored once however often it occurs; bridge rows (parent hash,
field, ordinal, child hash) rebuild every tree; a record is the hashes of its roots. The elements of each record come
from the bridge: its root hash is followed through the links, which keep every occurrence with its place and parent.

A task stores what its records hold, HELD objects and links at a time, and `found` follows their root hashes through that
store, so nothing is shuffled. `occurrences` writes the stores of all tasks, each object and link once for a task and with
its count, so that one that a third of all records share is a row for each task; `objects`, `bridge` and `records` are the
tables of the whole, and `elements` has the elements from them, where the bodies are no longer at hand.

Defined results: null, blank, cut-off or otherwise invalid bodies (NaN and Infinity are no JSON) and bodies that are no
object give no rows, bodies of any depth are read; rows without an id are left out, repeated ids are records of their own;
of a repeated field name the last counts; 1 and 1.0 are two values; an unknown field is kept like any other; an array that is not named in ARRAYS is walked through, but its elements are
no elements in the sense of the result.
"""

import hashlib
import json
import re
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.session import few, written

# The fields that hold arrays of objects, and the roots that are flattened.
ARRAYS = ("rules", "examples", "layers", "entries", "schemes", "fallbacks", "stages", "steps", "checks", "history", "notes")
ROOTS = ("pipeline_config", "status")

#: kind 0: a record (a: hash of its configuration, b: of its status); 1: an object (a: hash, body); 2: a link (a: parent,
#: b: child). n: how often a task met it.
STORE = "kind int, rec_id long, job_id string, a string, b string, step string, field string, ordinal int, is_element boolean, body string, n long"
#: Objects and links that a task holds before it writes them; links that are broadcast, beyond which they are joined.
HELD, MAX_LINKS = 50_000, 200_000
FOUND = "rec_id long, path string, parent_path string"

_blank = re.compile(r"[ \t\n\r]*")
_number = re.compile(r"-?(?:0|[1-9]\d*)(?P<rest>(?:\.\d+)?(?:[eE][-+]?\d+)?)")
_names = {"true": True, "false": False, "null": None}


def _refuse(name):
    raise ValueError(name)


def read_json(text: str):
    """The value of a JSON text of any depth; ValueError where it is none."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _read_deep(text)
    except ValueError as e:
        if "Exceeds the limit" in str(e):  # of digits that Python makes a number of
            return _read_deep(text)
        raise


def _read_deep(t: str):
    """A reader with a stack of its own: [container, name of the field to come] of every open object and array."""
    top: list = []
    stack, want, i = [[top, None]], "value", 0
    while True:
        i = _blank.match(t, i).end()
        c = t[i : i + 1]
        box = stack[-1]
        if want in ("first value", "value"):
            if c == "]" and want == "first value":
                stack.pop()
                want, i = "next", i + 1
                continue
            new = None
            if c in ("{", "["):
                new, i = ({} if c == "{" else []), i + 1
                value = new
            elif c == '"':
                value, i = scanstring(t, i + 1, True)
            elif m := _number.match(t, i):
                value, i = float(m.group()) if m["rest"] else int(m.group()) if len(m.group()) < 4000 else m.group(), m.end()
            else:
                name = next((n for n in _names if t.startswith(n, i)), None)
                if name is None:
                    raise ValueError(f"no value at {i}")
                value, i = _names[name], i + len(name)
            if isinstance(box[0], dict):
                box[0][box[1]] = value
            else:
                box[0].append(value)
            if new is not None:
                stack.append([new, None])
            want = "next" if new is None else "first name" if c == "{" else "first value"
        elif want in ("first name", "name"):
            if c == "}" and want == "first name":
                stack.pop()
                want, i = "next", i + 1
                continue
            if c != '"':
                raise ValueError(f"no name at {i}")
            box[1], i = scanstring(t, i + 1, True)
            i = _blank.match(t, i).end()
            if t[i : i + 1] != ":":
                raise ValueError(f"no colon at {i}")
            want, i = "value", i + 1
        elif box[0] is top:
            if i < len(t):
                raise ValueError(f"more text at {i}")
            return top[0]
        elif c == ",":
            want, i = ("name" if isinstance(box[0], dict) else "value"), i + 1
        elif c == ("}" if isinstance(box[0], dict) else "]"):
            stack.pop()
            i += 1
        else:
            raise ValueError(f"no end at {i}")


def locate_config(body: dict):
    """The non-null pipeline_config nearest to the top, at most two objects deep; JSON text is read."""
    level = [body]
    for _ in range(3):
        for o in level:
            if (c := o.get("pipeline_config")) is not None:
                if isinstance(c, str):
                    try:
                        c = read_json(c)
                    except ValueError:
                        return None
                return c if isinstance(c, dict) else None
        level = [v for o in level for v in o.values() if isinstance(v, dict)]
    return None


def flatten(top: dict):
    """Nodes of a tree, parents first: [owner index, step from the owner, field, ordinal, is_element, object, children]."""
    nodes = [[None, "", "", 0, False, top, []]]
    k = 0
    while k < len(nodes):
        obj, children = nodes[k][5:]
        for name, value in obj.items():
            if isinstance(value, dict):
                listed = name in ARRAYS
                found = [(f".{name}[0]" if listed else f".{name}", 0, listed, value)]
            elif isinstance(value, list):
                found, todo = [], [(f".{name}", value, True)]
                while todo:
                    at, values, direct = todo.pop()
                    for i, x in enumerate(values):
                        if isinstance(x, dict):
                            found.append((f"{at}[{i}]", i, direct and name in ARRAYS, x))
                        elif isinstance(x, list):
                            todo.append((f"{at}[{i}]", x, False))
            else:
                continue
            for step, i, e, x in found:
                children.append(len(nodes))
                nodes.append([k, step, name, i, e, x, []])
        k += 1
    return nodes


def _dump(value, refs: dict) -> str:
    """JSON of one object, {"$ref": hash} in the place of each object below it; own names that begin with $ get another $."""
    out: list[str] = []
    todo = [(False, value)]
    while todo:
        done, v = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict) and v is not value:
            out.append(f'{{"$ref":"{refs[id(v)]}"}}')
        elif isinstance(v, (dict, list)):
            parts = []
            for n in sorted(v) if isinstance(v, dict) else range(len(v)):
                parts += [(True, "," if parts else ""), (True, json.dumps("$" + n if n[:1] == "$" else n, ensure_ascii=False) + ":" if isinstance(v, dict) else ""), (False, v[n])]
            todo += [(True, "]}"[isinstance(v, dict)]), *reversed(parts), (True, "[{"[isinstance(v, dict)])]
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def hashes(nodes) -> list[tuple[str, str]]:
    """(hash, canonical body) of each node; a body holds its children's hashes in their places."""
    out: list = [None] * len(nodes)
    refs: dict[int, str] = {}
    for k in range(len(nodes) - 1, -1, -1):
        obj = nodes[k][5]
        if nodes[k][6] or any(isinstance(v, (dict, list)) or n[:1] == "$" for n, v in obj.items()):
            body = _dump(obj, refs)
        else:
            body = json.dumps(obj, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        refs[id(obj)] = h = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        out[k] = h, body
    return out


def _plain(s: str) -> str:
    """A text that Arrow takes: halves of surrogate pairs become ?."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def _rows(rec_id, job_id, text, objects: dict, links: dict):
    """The record's row; its objects and links are counted in the two dicts."""
    try:
        body = read_json(text)
    except ValueError:
        return None
    if not isinstance(body, dict):
        return None
    roots = []
    for top in (locate_config(body), body.get("status")):
        if not isinstance(top, dict):
            roots.append(None)
            continue
        nodes = flatten(top)
        hs = hashes(nodes)
        roots.append(hs[0][0])
        for (owner, step, field, ordinal, element, _, _), (h, canon) in zip(nodes, hs):
            o = objects.get(h)
            if o is None:
                o = objects[h] = [_plain(canon), 0]
            o[1] += 1
            if owner is not None:
                key = hs[owner][0], h, step, field, ordinal, element
                links[key] = links.get(key, 0) + 1
    return (0, rec_id, job_id, *roots, None, None, None, None, None, 1) if any(roots) else None


def occurrences(df: DataFrame, id_col: str = "rec_id", body_col: str = "body", job_col: str = "job_id") -> DataFrame:
    """STORE rows of all records, written: every record, the objects and the links that its task met, each once with a count."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [n.split() for n in STORE.split(", ")]

    def walk(batches):
        objects: dict = {}
        links: dict = {}

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(list(zip(*rows)) or [[] for _ in fields], fields)], names=[n for n, _ in fields])

        def held():
            rows = [(1, None, None, h, None, None, None, None, None, b, n) for h, (b, n) in objects.items()]
            rows += [(2, None, None, p, c, _plain(step), _plain(field), i, e, None, n) for (p, c, step, field, i, e), n in links.items()]
            objects.clear()
            links.clear()
            return batch(rows)

        for b in batches:
            rows = []
            for i, j, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                if t and (r := _rows(i, j, t, objects, links)):
                    rows.append(r)
                if len(objects) + len(links) > HELD:
                    yield held()
            yield batch(rows)
        yield held()

    job = F.col(job_col).cast("string") if job_col in df.columns else F.lit(None).cast("string")
    return written(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("rec_id"), job.alias("job_id"), F.col(body_col).alias("body")).mapInArrow(walk, STORE), "p2-store")


def expanded(roots, below: dict, limit: int = 1 << 23):
    """FOUND batches of (record, root, hash) rows, followed through below: hash to (step, is_element, child hash)."""
    size, rows = 0, []

    def batch():
        cols = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["rec_id", "path", "parent_path"])

    for rec, root, top in roots:
        todo = [(root, "$", top)]
        while todo:
            path, inside, h = todo.pop()
            for step, element, child in below.get(h, ()):
                at = path + step
                if element:
                    rows.append((rec, at, inside))
                    size += len(at)
                if child in below:
                    todo.append((at, at if element else inside, child))
            if size > limit:
                yield batch()
                size, rows = 0, []
    yield batch()


def found(df: DataFrame, id_col: str = "rec_id", body_col: str = "body") -> DataFrame:
    """(rec_id, path, parent_path) of the elements of arrays of objects of each record, through the store of its task."""

    def walk(batches):
        objects: dict = {}
        links: dict = {}
        tops: list = []

        def held():
            below: dict = {}
            for parent, child, step, _, _, element in links:
                below.setdefault(parent, []).append((_plain(step), element, child))
            yield from expanded(tops, below)
            for x in (objects, links, tops):
                x.clear()

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and (r := _rows(i, None, t, objects, links)):
                    tops += [(i, root, h) for root, h in zip(ROOTS, r[3:5]) if h]
                if len(objects) + len(links) + len(tops) > HELD:
                    yield from held()
        yield from held()

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("rec_id"), F.col(body_col).alias("body")).mapInArrow(walk, FOUND)


def elements(store: DataFrame) -> DataFrame:
    """(rec_id, path, parent_path) of the elements of arrays of objects.

    Each root hash is followed through the links. While the different links are few, which is counted, every task has them
    all; beyond, the different roots are expanded by joins, a level of nesting a round, and then joined to their records.
    """
    links = store.where("kind = 2").groupBy("a", "b", "step").agg(F.max("is_element").alias("is_element"))
    links = written(links, "p2-links")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.col(c).alias("hash")) for r, c in zip(ROOTS, "ab")])).alias("x")
    roots = store.where("kind = 0").select("rec_id", each).select("rec_id", "x.root", "x.hash").where("hash is not null")
    return _by_map(roots, links) if few(links, MAX_LINKS) else _by_levels(roots, links)


def _by_map(roots: DataFrame, links: DataFrame) -> DataFrame:
    below: dict[str, list] = {}
    for parent, child, step, element in zip(*(c.to_pylist() for c in links.toArrow().columns)):
        below.setdefault(parent, []).append((step, element, child))

    def expand(batches):
        for b in batches:
            yield from expanded(zip(*(b.column(k).to_pylist() for k in range(3))), below)

    return roots.select("rec_id", "root", "hash").mapInArrow(expand, FOUND)


def _by_levels(roots: DataFrame, links: DataFrame) -> DataFrame:
    tops = roots.select("root", "hash").distinct()
    level = tops.select(F.col("root"), F.col("hash").alias("top"), F.col("root").alias("path"), F.lit("$").alias("inside"), "hash")
    found = []
    while not level.isEmpty():
        path = F.concat("path", "step")
        level = level.select("root", "top", "path", "inside", "hash").join(links, F.col("hash") == F.col("a")).select("root", "top", path.alias("path"), F.col("inside").alias("parent_path"), F.when(F.col("is_element"), path).otherwise(F.col("inside")).alias("inside"), "is_element", F.col("b").alias("hash"))
        level = written(level, "p2-level")
        found.append(level.where("is_element").select("root", F.col("top").alias("hash"), "path", "parent_path"))
    if not found:
        return roots.select("rec_id", F.col("root").alias("path"), F.col("root").alias("parent_path")).limit(0)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return roots.join(every, ["root", "hash"]).select("rec_id", "path", "parent_path")


def objects(store: DataFrame) -> DataFrame:
    """(hash, body, n_occurrences): each different object once."""
    return store.where("kind = 1").groupBy(F.col("a").alias("hash")).agg(F.max("body").alias("body"), F.sum("n").alias("n_occurrences"))


def bridge(store: DataFrame) -> DataFrame:
    """(parent_hash, step, field, ordinal, child_hash, n_occurrences): the links between different objects."""
    return store.where("kind = 2").groupBy(F.col("a").alias("parent_hash"), "step", "field", "ordinal", F.col("b").alias("child_hash")).agg(F.sum("n").alias("n_occurrences"))


def records(store: DataFrame) -> DataFrame:
    """(rec_id, job_id, config_hash, status_hash): one row per record that has either tree."""
    return store.where("kind = 0").select("rec_id", "job_id", F.col("a").alias("config_hash"), F.col("b").alias("status_hash"))
