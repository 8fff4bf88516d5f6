"""Sources with comments, strings and templates: what is found is what the language would see."""

import pytest
from pyspark.sql import functions as F
from strataline.functions.text import segments
from strataline.operators import extraction as X
from strataline.operators import manifests as M

TS = """// router.get('/commented', h)
/* app.post("/also", h) */
const s = "router.get('/in-a-string')";
router.get('/v1/items/:id', h); app . use ( "/mount", r )
import a from 'pkg/sub'; import './local'
import '@scope/name/deep'
const lazy = import("lazy-one"); const q = require('req');
const one = config.first;
let two = `${ config.second }`;
const { third, fourth: four } = config;
const { no } = config.other;
const one = config.again
http.get(`${one}/a/${id}/b?x=1`); http.post(`${config.main}/m`)
fetch(`${two}/t`); z(`${four}/f`); z(`${unbound}/u`); z(`x ${third}/late`)
z(`${one}`); z(`${a.b}/member`); // http.get(`${one}/comment`)
multi(`
  ${third}/lines`)
const k = process.env.API_KEY + import.meta.env.VITE_URL + process.env.ab; const u = `https://${h}/x`
const w = "https://API.acme.io:80/x", v = 'http://localhost/', y = "https://1.2.3.4/", t = "https://www.w3.org/x"
"""
GO = """package main
import (
	"fmt"
	"github.com/acme/lib/sub/deep"
	alias "gopkg.in/yaml.v3"
	// "github.com/not/this"
)
import "example.io/single/x"
func main() { r.GET("/v1/x", h); r . HandleFunc( "/y", h); g.Group("/admin"); r.GET("relative", h); r.Get("/wrong") }
var s = `r.POST("/raw", h)` // r.PUT("/c", h)
var k = os.Getenv("KEY_1"); var t = "see github.com/a/b"
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("web/a.ts", TS), ("svc/b.go", GO), ("svc/none.go", ""), ("web/null.ts", None)], "path string, text string").cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_routes(files):
    assert rows(X.route_registrations(files)) == [("svc/b.go", 9, "GET", "/v1/x"), ("svc/b.go", 9, "HANDLEFUNC", "/y"), ("web/a.ts", 4, "GET", "/v1/items/:id")]
    assert [r[3] for r in rows(X.route_registrations(files, mounts=True)) if r[2] in X.MOUNTS] == ["/admin", "/mount"]


def test_calls(files):
    got = [r[1:] for r in rows(X.ui_calls(files))]
    assert got == [(13, "again", "/a/${id}/b", "GET"), (13, "main", "/m", "POST"), (14, "fourth", "/f", ""), (14, "second", "/t", ""), (14, "third", "/late", ""), (14, "unbound", "/u", ""), (17, "third", "/lines", ""), (18, "h", "/x", "")]


def test_imports_environment_and_hosts(files):
    assert [r[1:] for r in rows(X.imports(files))] == [(4, "github.com/acme/lib"), (5, "gopkg.in/yaml.v3"), (8, "example.io/single/x"), (5, "pkg"), (6, "@scope/name"), (7, "lazy-one"), (7, "req")]
    assert [r[2] for r in rows(X.environment(files))] == ["KEY_1", "API_KEY", "VITE_URL"]
    assert rows(X.hosts(files)) == [("web/a.ts", 19, "api.acme.io")]


@pytest.mark.parametrize(
    ("path", "expected"),
    [("/v1/a/:id/{x}/${y}/$z", "a/*/*/*/*"), ("${base}/${more}/v2/a?b=/c#d", "a"), ("/*/users", "users"), ("/a/v1/*path", "a/v1/*path"), ("/v1/v2/a", "v2/a"), ("{id/x", "*/x"), ("/", ""), ("/*/${x}", ""), ("#/a", "")],
)
def test_segments(spark, path, expected):
    assert spark.range(1).select(F.array_join(segments(F.lit(path)), "/")).first()[0] == expected


def test_names_and_words_of_deployment(spark):
    names = ["compose.yml", "Docker-Compose.prod.YAML", "docker-compose-a_b.yml", "my-compose.yml", "compose.yml.bak", "compose x.yml", "composer.yml"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.filter(M.is_compose(F.col("n"))).collect()] == ["compose.yml", "Docker-Compose.prod.YAML", "docker-compose-a_b.yml", "composer.yml"]
    texts = ["run: Deploy", "kubectl apply", "docker   push x", "docker\npush", "redeploy", "deploy_all", "pre-release!", "docker-push", "helmet"]
    df = spark.createDataFrame([(n,) for n in texts], "t string")
    assert [r[0] for r in df.filter(M.deploys(F.col("t"))).collect()] == ["run: Deploy", "kubectl apply", "docker   push x", "docker\npush", "pre-release!"]
    policies = spark.createDataFrame([("a.conf", "[matchers]\nm = x"), ("b.csv", "x\n  p , admin, all"), ("c.csv", "pp, x"), ("d.txt", "p, a"), ("e.csv", "g,a,b")], "path string, text string")
    assert rows(M.policy_files(policies)) == [("a.conf", "casbin-model"), ("b.csv", "casbin-policy"), ("e.csv", "casbin-policy")]
