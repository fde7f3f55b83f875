"""Base tags of ten languages: rows worked out by hand from each language's rules, in the order in which tags are found."""

import pytest
from pyspark.sql import functions as F

from tagweave.functions import basetags

#: Language, symbol, signature, path, module hint, and the tags.
ROWS = [
    ('cpp', 'geo::shape::Circle::areaOf', 'double Circle::areaOf(int scale) const', 'src/geo/circle_math.cpp', 'geo', 'geo circle math shape area'),
    ('cpp', 'geo::RoundShape', 'class RoundShape : public base::ShapeNode, private Counted', 'src/geo/RoundShape.h', 'geo', 'geo round shape class roundshape shapenode base node counted'),
    ('java', 'com.acme.HttpClient.openStream', '@Override public static int openStream(String url)', 'app/net/HttpClient.java', 'app/net', 'net http com acme open stream httpclient static override'),
    ('java', 'com.acme.Pool', 'public abstract class Pool extends BasePool implements Closeable, java.util.Queue', 'app/net/Pool.java', 'app/net', 'net pool com acme class abstract basepool base closeable java'),
    ('js', 'TagStore', 'export default class TagStore extends BaseStore', 'web/ui/tag_store.tsx', 'web/ui', 'web ui tag store jsx component typescript class export default basestore base'),
    ('js', 'pickOne', 'export const pickOne = async () => ...', 'web/Box.vue', 'web', 'web box vue component pick one async export arrow'),
    ('python', 'A.Worker.__init__', 'def __init__(self, size)', 'pkg/jobs/__init__.py', 'pkg/jobs', 'pkg jobs worker function constructor dunder method'),
    ('python', 'Worker.run_all', '@cached\n@staticmethod\nasync def run_all(cls)', 'pkg/jobs/work_queue.py', 'pkg/jobs', 'pkg jobs work queue worker all function async classmethod cached'),
    ('python', 'Worker', 'class Worker(base.Thread, object)', 'pkg/jobs/work_queue.py', 'pkg/jobs', 'pkg jobs work queue worker class thread'),
    ('go', 'srv.HttpServer.ServeAll', 'func (s *HttpServer) ServeAll(addr string) error', 'cmd/srv/server_test.go', 'cmd/srv', 'srv http serve all httpserver func exported method server'),
    ('rust', 'read_all', 'pub async fn read_all<T>(r: T)', 'crates/io/lib.rs', 'crates/io', 'crates io read all function async public'),
    ('rust', 'Reader', 'impl Read for Reader', 'crates/io/buf_reader.rs', 'crates/io', 'crates io buf reader impl read'),
    ('ruby', 'User::find_all', 'def self.find_all(id)', 'lib/user_store.rb', 'lib', 'user store find all method classmethod'),
    ('ruby', 'User', 'class User < Record', 'lib/user_store.rb', 'lib', 'user store class record'),
    ('php', 'App\\Data\\RepoStore', 'final class RepoStore extends Base implements Countable, \\It', 'inc/RepoStore.php', 'inc', 'inc repo store app data class base countable'),
    ('csharp', 'Acme.Core.JobQueue', '[Serializable] public abstract class JobQueue : IQueue', 'src/Core/JobQueue.cs', 'src/Core', 'src core job queue acme class abstract iqueue serializable'),
    ('bash', 'push_all-now', 'function push_all-now()', 'bin/deploy_all.sh', 'bin', 'shell script deploy all push now function'),
]


@pytest.mark.parametrize("lang", sorted({r[0] for r in ROWS}))
def test_golden_rows(spark, lang):
    rows = [r for r in ROWS if r[0] == lang]
    found = spark.createDataFrame([(i, *r[1:5]) for i, r in enumerate(rows)], "n int, symbol string, signature string, path string, hint string").select("n", basetags.base_tags(lang, *map(F.col, ("symbol", "signature", "path", "hint"))).alias("tags"))
    got = {r.n: " ".join(r.tags) for r in found.collect()}
    assert [got[i] for i in range(len(rows))] == [r[5] for r in rows]


def test_rows_of_several_languages_and_of_unknown_ones(spark):
    rows = spark.createDataFrame([("go", "srv.Run", "func Run()", "cmd/a.go", ""), ("xx", "n::Thing", "struct Thing", "src/thing.h", "n"), (None, "x", "int x()", "x.c", None)], "lang string, symbol string, signature string, path string, hint string")
    got = {r.lang: r.tags for r in basetags.with_base_tags(rows, "tags", "symbol", "signature", "path", "hint").collect()}
    assert set(got) == {"go", "xx", None} and "exported" in got["go"] and {"thing", "struct"} <= set(got["xx"])


def test_tags_of_path_and_id_alone(spark):
    row = spark.createDataFrame([("geo::RoundShape", "src/geo/circle_math.cpp")], "symbol string, path string").select(basetags.path_tags(F.col("symbol"), F.col("path")).alias("t")).first()
    assert row.t == ["geo", "circle", "math", "round", "shape"]
