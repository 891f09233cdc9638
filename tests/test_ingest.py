"""Project trees: parsers, discovery, resolution, incremental runs, the stream, the tools."""

import json
import os
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.api import Engine
from tessera.operators import diff
from tessera.operators.counts import counts_of
from tessera.sources import corpus, project, sinks
from tessera.sources.parsers import parse
from tessera.sources.parsers.metadata import formula_references
from tessera.sources.parsers.soql import extract, sosl_objects
from tessera.streaming import commits, ingest
from tessera.streaming.ingest import Index, index_project

TREE = {
    "classes/Base.cls": "public abstract class Base { }",
    "classes/Cleanable.cls": "public interface Cleanable { void clean(); }",
    "classes/Service.cls": """/* a service */
public with sharing class Service extends Base implements Cleanable {
    private static Integer total = 0, other = f(1, 2);
    public String title { get; set; }
    public Service(Integer n) { this.total = n; }
    @AuraEnabled(cacheable=true)
    public static List<Account> find(String name, Map<String, List<Id>> more) {
        // not a call: ghost();
        for (Account a : [SELECT Id, a.Name, Owner.Alias, (SELECT LastName FROM Contacts WHERE Email != null) FROM Account a WHERE Tier__c IN :tiers(1) ORDER BY Name DESC LIMIT 5]) { purge(); }
        return null;
    }
    public void clean() { purge(); Service s = new Service(1); Other.go(1, 'a,b'); s.clean(); Database.query(text); }
    private static void purge() { List<List<SObject>> r = [FIND 'x' IN ALL FIELDS RETURNING Account(Id), Contact]; }
    public enum Mode { ON, OFF }
    public class Inner { public void run() { Service.find('a', null); } }
}""",
    "classes/Other.cls": "public class Other { public static void go(Integer a, String b) {} public static void go() {} public static void go(Integer c, Integer d) {} }",
    "classes/Broken.cls": "public class Broken { void x( }",
    "triggers/AccountTrigger.trigger": "trigger AccountTrigger on Account (before insert, after update) { Service.purge(); List<Account> x = [SELECT Tier__c FROM Account]; }",
    "objects/Account/fields/Tier__c.field-meta.xml": "<?xml version='1.0' encoding='UTF-8'?><CustomField xmlns='http://x'><fullName>Tier__c</fullName><type>Picklist</type><valueSet><valueSetDefinition><value><fullName>A</fullName></value><value><fullName>B</fullName></value></valueSetDefinition></valueSet></CustomField>",
    "objects/Account/fields/Name.field-meta.xml": "<CustomField><fullName>Name</fullName><type>Text</type></CustomField>",
    "objects/Account/fields/OwnerId.field-meta.xml": "<CustomField><fullName>OwnerId</fullName><type>Lookup</type><referenceTo>User</referenceTo></CustomField>",
    "objects/User/User.object-meta.xml": "<CustomObject><label>User</label></CustomObject>",
    "objects/User/fields/Alias.field-meta.xml": "<CustomField><fullName>Alias</fullName><type>Text</type></CustomField>",
    "objects/Contact/Contact.object-meta.xml": "<CustomObject><label>Contact</label></CustomObject>",
    "objects/Contact/fields/AccountId.field-meta.xml": "<CustomField><fullName>AccountId</fullName><type>Lookup</type><referenceTo>Account</referenceTo><relationshipName>Contacts</relationshipName></CustomField>",
    "objects/Contact/fields/LastName.field-meta.xml": "<CustomField><fullName>LastName</fullName><type>Text</type></CustomField>",
    "objects/Account/fields/Sum__c.field-meta.xml": "<CustomField><fullName>Sum__c</fullName><type>Summary</type><summarizedField>Contact.LastName</summarizedField></CustomField>",
    "objects/Account/validationRules/Need.validationRule-meta.xml": "<ValidationRule><fullName>Need</fullName><active>true</active><errorConditionFormula>AND(ISBLANK(Tier__c), $User.Alias = 'Name')</errorConditionFormula></ValidationRule>",
    "objects/Account/recordTypes/Big.recordType-meta.xml": "<RecordType><fullName>Big</fullName><active>true</active></RecordType>",
    "labels/CustomLabels.labels-meta.xml": "<CustomLabels><labels><fullName>Hello</fullName><value>Hi</value></labels><labels><fullName>Bye</fullName></labels></CustomLabels>",
    "permissionsets/Reader.permissionset-meta.xml": "<PermissionSet><classAccesses><apexClass>Service</apexClass><enabled>true</enabled></classAccesses><fieldPermissions><field>Account.Tier__c</field><readable>true</readable></fieldPermissions><objectPermissions><object>Account</object><allowRead>true</allowRead></objectPermissions></PermissionSet>",
    "profiles/Admin.profile-meta.xml": "<Profile><fieldPermissions><field>Account.Tier__c</field><editable>true</editable></fieldPermissions></Profile>",
    "permissionsetgroups/All.permissionsetgroup-meta.xml": "<PermissionSetGroup><permissionSets>Reader</permissionSets><permissionSets>Ghost</permissionSets></PermissionSetGroup>",
    "layouts/Account-Main.layout-meta.xml": "<Layout><layoutSections><label>S</label><layoutColumns><layoutItems><field>Tier__c</field></layoutItems><layoutItems><emptySpace>true</emptySpace></layoutItems></layoutColumns></layoutSections></Layout>",
    "flexipages/Home.flexipage-meta.xml": "<FlexiPage><sobjectType>Account</sobjectType><flexiPageRegions><itemInstances><componentInstance><componentName>c:card</componentName></componentInstance></itemInstances><itemInstances><fieldInstance><fieldItem>Record.Tier__c</fieldItem></fieldInstance></itemInstances></flexiPageRegions></FlexiPage>",
    "flows/Go.flow-meta.xml": "<Flow><start><object>Account</object><triggerType>RecordAfterSave</triggerType></start><actionCalls><name>a</name><actionType>apex</actionType><actionName>Service</actionName></actionCalls><recordLookups><name>Get</name><object>Contact</object><storeOutputAutomatically>true</storeOutputAutomatically><filters><field>LastName</field></filters></recordLookups><subflows><name>s</name><flowName>Nowhere</flowName></subflows><decisions><name>d</name><rules><conditions><leftValueReference>$Record.Tier__c</leftValueReference></conditions></rules></decisions><formulas><name>f</name><expression>{!Get.LastName} &amp; '{!$Record.Name}'</expression></formulas></Flow>",
    "staticresources/Logo.resource-meta.xml": "<StaticResource><contentType>image/png</contentType></StaticResource>",
    "email/Mail/Welcome.email-meta.xml": "<EmailTemplate><name>Welcome</name><subject>Hi {!Account.Name}</subject></EmailTemplate>",
    "email/Mail/Welcome.email": "Dear {!Account.Tier__c}, {!$Label.Hello}",
    "lwc/card/card.js": "import find from '@salesforce/apex/Service.find';\nimport TIER from '@salesforce/schema/Account.Tier__c';\nimport ACC from '@salesforce/schema/Account';\nimport HELLO from '@salesforce/label/c.Hello';\nimport LOGO from '@salesforce/resourceUrl/Logo';\nimport { x } from 'lwc';",
    "lwc/card/card.html": "<template><c-small-part name='a'></c-small-part></template>",
    "lwc/smallPart/smallPart.js": "export default 1;",
    "aura/panel/panel.cmp": "<aura:component controller=\"Service\"><c:card/><c:panel a='1'/></aura:component>",
    "aura/panel/panelController.js": "({ go: function(c) { c.get('c.find'); } })",
    "pages/View.page": "<apex:page controller=\"Service\" extensions=\"Other\"><c:Box/><apex:outputField value=\"{!Account.Tier__c}\"/></apex:page>",
    "components/Box.component": "<apex:component></apex:component>",
    "classes/.hidden.cls": "public class Hidden {}",
}


def write(root: Path, files: dict[str, str]) -> str:
    for name, text in files.items():
        at = root / "force-app/main/default" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (root / "sfdx-project.json").write_text(json.dumps({"packageDirectories": [{"path": "force-app"}, {"path": "absent"}], "sourceApiVersion": "60.0"}))
    return str(root)


def graph_facts(graph, p=1):
    n = graph.project_nodes(p).select("id", "label", "qualified_name")
    e = graph.project_edges(p)
    e = e.join(n.select(F.col("id").alias("source_id"), F.col("label").alias("a"), F.col("qualified_name").alias("aq")), "source_id")
    e = e.join(n.select(F.col("id").alias("target_id"), F.col("label").alias("b"), F.col("qualified_name").alias("bq")), "target_id")
    nodes = sorted((r["label"], r["qualified_name"], r["properties"]) for r in graph.project_nodes(p).collect())
    return nodes, sorted((r["aq"], r["edge_type"], r["bq"], r["confidence"], r["properties"]) for r in e.collect())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = write(tmp_path_factory.mktemp("tree"), TREE)
    index, counts = index_project(Index.empty(spark), root, "full", at=5)
    return root, index, counts


def test_soql():
    q = extract("SELECT Id, Name n, COUNT(Id) c, TYPEOF What WHEN Account THEN Phone ELSE Name END FROM Task t WHERE t.Status = 'x' AND (NOT Who.Name LIKE :a.b) GROUP BY Name HAVING COUNT(Id) > 1 ORDER BY c, Name NULLS LAST LIMIT :n FOR UPDATE")
    assert q.object == "Task"
    assert ("Task", "Status", "SOQL_WHERE") in q.fields and ("Task", "Who.Name", "SOQL_WHERE") in q.fields and ("Account", "Phone", "SOQL_SELECT") in q.fields
    assert ("Task", "c", "SOQL_ORDER_BY") not in q.fields and ("Task", "Name", "SOQL_ORDER_BY") in q.fields
    semi = extract("SELECT Id FROM A WHERE Id IN (SELECT AId FROM B WHERE X IN ('a', 'b'))")
    assert semi.objects == ["B", "A"] and ("B", "X", "SOQL_WHERE") in semi.fields
    assert extract("SELECT FIELDS(ALL) FROM A LIMIT 1").warnings and extract("SELECT Id, id FROM A").fields == [("A", "Id", "SOQL_SELECT")]
    for bad in ("SELECT FROM A", "SELECT Id", "SELECT Id FROM A WHERE", "SELECT Id FROM A WHERE x = ", "SELECT Id FROM A junk here", "SELECT (SELECT FROM B) FROM A", ""):
        assert extract(bad) is None
    assert sosl_objects("FIND 'x' RETURNING Account(Id), Contact") == ["Account"]


def test_formula():
    assert formula_references("AND(ISBLANK(Tier__c), Owner . Alias = $User.Name, a.b.c, TRUE)", "Account") == ["Account.Tier__c", "Owner.Alias", "$User.Name", "a.b.c"]


def test_parse_failure_is_a_warning():
    assert [r["rec"] for r in parse("flow", "x.flow-meta.xml", None, [("x", "<Flow>")]).rows] == ["warning"]


def test_warnings_are_counted(spark):
    rows = [("warning", f"text {i:03}", f"f{i:03}") for i in range(130)] + [("node", None, "f")]
    got = ingest._warnings(spark.createDataFrame(rows, "rec string, text string, file_path string"))
    assert got == {"warnings": [f"text {i:03}" for i in range(100)], "warning_count": 130}


def test_discovery(spark, indexed):
    found = {r["file_path"].split("main/default/")[1]: r for r in project.discover(spark, indexed[0]).collect()}
    assert len(found) == len([f for f in TREE if "/." not in f]) - 3  # two bundles of two files, one mail with its body
    assert found["lwc/card"]["kind"] == "lwc" and found["email/Mail/Welcome.email-meta.xml"]["parent"] == "Mail"
    assert found["objects/Account/fields/Tier__c.field-meta.xml"]["parent"] == "Account"
    with pytest.raises(project.ManifestError):
        project.read_manifest(spark, str(Path(indexed[0]) / "force-app"))


def test_graph_of_the_tree(indexed):
    nodes, edges = graph_facts(indexed[1].graph)
    kinds = {(label, q) for label, q, _ in nodes}
    assert {("ApexClass", "Service.Inner"), ("ApexEnum", "Service.Mode"), ("ApexMethod", "Service.find(String, Map)"), ("ApexMethod", "Service.Service(Integer)"), ("ApexProperty", "Service.other"), ("ApexProperty", "Service.title"), ("CustomLabel", "c.Hello"), ("RecordType", "Account.Big"), ("VisualforceComponent", "Box")} <= kinds
    assert not any(q == "Broken" for _, q in kinds)
    props = {q: json.loads(p) for label, q, p in nodes}
    assert props["Account"]["isPlaceholder"] and "isPlaceholder" not in props["Contact"] and props["Service"]["sharing"] == "with"
    assert props["Account.Tier__c"]["picklistValues"] == ["A", "B"] and props["Service.find(String, Map)"]["isAuraEnabled"]
    have = {(a, t, b): c for a, t, b, c, _ in edges}
    for edge, confidence in {
        ("Service", "EXTENDS", "Base"): 1.0, ("Service", "IMPLEMENTS", "Cleanable"): 1.0, ("Service.clean()", "CALLS", "Service.purge()"): 1.0,
        ("Service.clean()", "INSTANTIATES", "Service"): 1.0, ("Service.clean()", "CALLS", "Other.go(Integer, Integer)"): 0.4, ("Service.Inner.run()", "CALLS", "Service.find(String, Map)"): 1.0,
        ("Service.find(String, Map)", "SOQL_QUERIES", "Account"): 1.0, ("Service.find(String, Map)", "SOQL_QUERIES", "Contact"): 1.0, ("Service.find(String, Map)", "REFERENCES_FIELD", "User.Alias"): 1.0,
        ("Service.find(String, Map)", "REFERENCES_FIELD", "Contact.LastName"): 1.0, ("Service.purge()", "SOSL_QUERIES", "Account"): 0.6, ("AccountTrigger", "TRIGGERS_ON", "Account"): 1.0,
        ("AccountTrigger", "REFERENCES_FIELD", "Account.Tier__c"): 1.0, ("Account.Need", "VALIDATION_REFERENCES_FIELD", "Account.Tier__c"): 0.6, ("Account.Sum__c", "FORMULA_REFERENCES_FIELD", "Contact.LastName"): 0.8,
        ("Reader", "GRANTS_APEX_ACCESS", "Service"): 1.0, ("All", "INCLUDES_PERMSET", "Reader"): 1.0, ("Account-Main", "LAYOUT_INCLUDES_FIELD", "Account.Tier__c"): 1.0,
        ("Home", "FLEXIPAGE_INCLUDES_COMPONENT", "card"): 0.8, ("Home", "FLEXIPAGE_REFERENCES_FIELD", "Account.Tier__c"): 1.0, ("Go", "INVOCABLE_FROM_FLOW", "Service"): 0.8,
        ("Go", "FLOW_DML_ON", "Contact"): 1.0, ("Go", "FLOW_USES_FIELD", "Account.Tier__c"): 1.0, ("Mail/Welcome", "EMAIL_REFERENCES_FIELD", "Account.Tier__c"): 0.6, ("Mail/Welcome", "REFERENCES_LABEL", "c.Hello"): 0.6,
        ("card", "LWC_USES_APEX", "Service.find(String, Map)"): 0.8, ("card", "LWC_USES_FIELD", "Account.Tier__c"): 1.0, ("card", "REFERENCES_FIELD", "Account"): 1.0, ("card", "LWC_INCLUDES_COMPONENT", "smallPart"): 1.0,
        ("card", "LWC_USES_RESOURCE", "Logo"): 1.0, ("panel", "AURA_USES_APEX", "Service"): 1.0, ("panel", "AURA_INCLUDES_COMPONENT", "card"): 1.0, ("View", "VF_USES_APEX", "Other"): 1.0,
        ("View", "VF_USES_FIELD", "Account.Tier__c"): 0.6, ("View", "VF_INCLUDES_COMPONENT", "Box"): 1.0,
    }.items():
        assert have.get(edge) == confidence, edge
    assert not any(t == "FLOW_INVOKES_FLOW" or b == "Ghost" for _, t, b in have)
    assert not any(a == "AccountTrigger" and t == "CALLS" for a, t, b in have)
    assert any("dynamic query" in w for w in indexed[2]["warnings"]) and any("apex_class" in w for w in indexed[2]["warnings"])


def test_incremental_run_ends_as_a_full_one(spark, indexed, tmp_path):
    root = write(tmp_path / "t", {k: v for k, v in TREE.items() if not k.startswith("aura")})
    index, _ = index_project(Index.empty(spark), root, at=1)
    again, counts = index_project(index, root, at=2)
    assert counts["files_parsed"] == 0 and graph_facts(again.graph) == graph_facts(index.graph)
    write(tmp_path / "t", {"classes/Other.cls": "public class Other { public static void go(Integer a, String b) {} public void late() { Service.purge(); } }"})
    (tmp_path / "t/force-app/main/default/labels/CustomLabels.labels-meta.xml").unlink()
    after, counts = index_project(again, root, at=3)
    assert (counts["files_parsed"], counts["files_removed"]) == (1, 1)
    full, _ = index_project(Index.empty(spark), root, "full", at=4)
    assert graph_facts(after.graph) == graph_facts(full.graph)
    assert kept_counts(index) == recount(index) and kept_counts(after) == recount(after) != recount(index) and kept_counts(full) == recount(full)
    kept = {r["qualified_name"]: r["id"] for r in index.graph.nodes.collect()}
    assert all(kept[r["qualified_name"]] == r["id"] for r in after.graph.nodes.collect() if r["qualified_name"] in kept)


def test_engine(spark, indexed, tmp_path):
    root = indexed[0]
    engine = Engine(spark, str(tmp_path / "store"))
    p = engine.index_project(root)["project_id"]
    assert engine.list_projects()[0]["node_count"] > 30 and engine.get_schema(p)["api_version"] == "60.0"
    assert engine.search_graph(p, labels="ApexClass", name_pattern="^serv")["results"][0]["name"] == "Service"
    assert {n["qualified_name"] for n in engine.trace_references(p, "Other", direction="in", depth=1)["nodes"]} == {"Other", "View"}
    got = engine.get_source_snippet(p, "other", 0)
    assert got["source"].startswith("public class Other") and engine.get_source_snippet(p, "SERVICE.CLEAN()", 1)["start_line"] == 11
    with pytest.raises(LookupError):
        engine.get_source_snippet(p, "Account.Nope")
    usage = engine.get_field_usage(p, "Account.Tier__c")
    assert usage["layouts"] and usage["email_templates"] and usage["permission_sets"] and usage["apex_triggers"]
    access = engine.get_permission_access(p, "field", "Account.Tier__c")
    assert access["total_grants"] == 2 and access["groups"][0]["members"] == ["Reader"]
    answer = engine.query_graph(p, "MATCH (c:ApexClass)-[:DEFINES_METHOD]->(m) RETURN c.name AS c, count(m) AS n ORDER BY n DESC LIMIT 1")
    assert answer["rows"] == [["Service", 4]] and "error" in engine.query_graph(p, "MATCH (a) DELETE a")
    other = engine.index_project(write(tmp_path / "two", {"classes/Base.cls": TREE["classes/Base.cls"]}))["project_id"]
    found = engine.diff_projects(other, p, limit=3)
    assert found["summary"]["removed"] == 0 and found["summary"]["added"] > 40 and found["has_more"]


def test_corpus_and_sinks(spark, tmp_path):
    made = corpus.generate(str(tmp_path / "c"), 12, 7)
    index, counts = index_project(Index.empty(spark), str(tmp_path / "c"))
    labels = {r["label"]: r["count"] for r in index.graph.nodes.groupBy("label").count().collect()}
    assert labels["ApexClass"] == made["classes"] and labels["ApexMethod"] == made["methods"] and counts["warnings"] == []
    twin = corpus.generate(str(tmp_path / "d"), 12, 7)
    assert twin == made and (tmp_path / "c/force-app/main/default/classes/Class3.cls").read_text() == (tmp_path / "d/force-app/main/default/classes/Class3.cls").read_text()
    assert json.loads(sinks.json_rows(spark.range(1)).first()["value"]) == {"id": 0}
    assert sinks.markdown_table(["a"], [("x|y",), (None,)]).splitlines()[2] == "| x\\|y |"
    assert sinks.bench_summary([{"tokens": 1, "other_tokens": 4, "ms": 1, "other_ms": 10, "found": [1, 2], "expected": [1]}]) == {"token_ratio": 0.25, "speed_up": 10, "recall": 1.0, "false_positives": 1}


def test_a_save_that_dies_leaves_the_version_before(spark, tmp_path):
    root, store = write(tmp_path / "p", {"classes/Base.cls": TREE["classes/Base.cls"]}), str(tmp_path / "store")
    index, _ = index_project(Index.empty(spark), root)
    index.graph.save(f"{store}/data/dead")  # what a run that dies before its commit leaves
    assert Index.load(spark, store).version == 0
    index.save(store)
    whole = graph_facts(Index.load(spark, store).graph)
    (tmp_path / "store/commits/.draft-x").write_text("{")
    again = Index.load(spark, store)
    assert again.version == 1 and graph_facts(again.graph) == whole and again.save(store) == 2
    last = commits.current(spark, store)[1]
    (Path(last) / "nodes.parquet").rename(tmp_path / "gone")
    with pytest.raises(Exception, match="nodes"):  # a store that can't be read isn't an empty one
        Index.load(spark, store).graph.nodes.count()


def recount(index):
    return sorted(map(tuple, counts_of(index.graph.nodes, index.graph.edges).collect()), key=str)


def kept_counts(index):
    return sorted(map(tuple, index.counts.select("project_id", "what", "id", "name", "outs", "ins").collect()), key=str)


def test_names_that_begin_with_an_underscore_and_empty_files(spark, tmp_path):
    root = write(tmp_path / "t", {"classes/_B.cls": "public class B {}", "classes/_more/C.cls": "public class C {}", "classes/.no/D.cls": "public class D {}", "lwc/card/card.js": "//", "lwc/card/_util.js": "", "classes/E[1]{2}.cls": "public class E {}"})
    for form in (root, f"file://{root}"):
        found = {r["file_path"].split("main/default/")[1]: [(p["name"], p["text"]) for p in r["parts"]] for r in project.discover(spark, form).collect()}
        assert found == {"classes/_B.cls": [("_B.cls", "public class B {}")], "classes/_more/C.cls": [("C.cls", "public class C {}")], "classes/E[1]{2}.cls": [("E[1]{2}.cls", "public class E {}")], "lwc/card": [("_util.js", ""), ("card.js", "//")]}
    (Path(root) / "sfdx-project.json").write_text('{"packageDirectories": [{"path": "absent"}]}')
    assert project.discover(spark, root).count() == 0


def test_only_changed_files_are_read(spark, tmp_path):
    root = write(tmp_path / "t", {"classes/A.cls": "public class A {}", "classes/B.cls": "public class B extends A {}", "lwc/card/card.js": "import x from 'c/other';", "lwc/card/util.js": "export const a = 1;", "lwc/own/own.js": "//", "classes/.C.cls": "public class C {}"})
    old = time.time() - 100
    for f in Path(root).rglob("*.*"):
        os.utime(f, (old, old))
    index, counts = index_project(Index.empty(spark), root)
    assert counts["files_read"] == 4 and {r["name"] for r in index.graph.nodes.where("label = 'ApexClass'").collect()} == {"A", "B"}
    parts = {r["file_path"].rsplit("/", 1)[-1]: [p["name"] for p in r["parts"]] for r in project.discover(spark, root).collect()}
    assert parts == {"A.cls": ["A.cls"], "B.cls": ["B.cls"], "card": ["card.js", "util.js"], "own": ["own.js"]}
    again, counts = index_project(index, root)
    assert (counts["files"], counts["files_read"], counts["files_parsed"]) == (4, 0, 0) and project.settled(spark, root)
    a = Path(root) / "force-app/main/default/classes/A.cls"
    os.utime(a, (old + 5, old + 5))  # another time, the same content: read, not parsed
    again, counts = index_project(again, root)
    assert (counts["files_read"], counts["files_parsed"]) == (1, 0)
    a.write_text("public class A { void go() {} }")
    os.utime(a, (time.time() + 600,) * 2)  # as if it changed at this moment
    assert not project.settled(spark, root)
    after, counts = index_project(again, root)
    assert (counts["files_read"], counts["files_parsed"]) == (1, 1) and after.graph.nodes.where("label = 'ApexMethod'").count() == 1
    assert after.stamps.where("stamp is null").count() == 1  # it changed just now: the next run looks again
    assert index_project(after, root)[1]["files_read"] == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    one, two = (write(tmp_path / n, {f"classes/{n}.cls": f"public class {n} {{}}"}) for n in ("One", "Two"))
    engines = [Engine(spark, store), Engine(spark, store)]  # both have read the empty store
    late = Index.load(spark, store)
    counts = [e.index_project(root) for e, root in zip(engines, (one, two), strict=True)]
    assert [c["project_id"] for c in counts] == [1, 2]  # the second was told of the first, and ran again
    stored = Index.load(spark, store)
    assert stored.version == 2 and {r["name"] for r in stored.graph.nodes.collect()} == {"One", "Two"}
    mine, _ = index_project(late, one)
    with pytest.raises(commits.CommitConflict):
        mine.save(store)
    assert Index.load(spark, store).version == 2 and len(list((tmp_path / "store/data").iterdir())) == 2

    def race(n):
        return commits._put_if_absent(spark, f"{tmp_path}/race/00", f"{n}\n")

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(race, range(16))) == 1


def peers(n, **changed):
    """Classes that call, extend and query in a ring: few of them depend on one."""
    made = {f"classes/C{i}.cls": f"public class C{i} {'extends C' + str(i - 1) if i % 3 == 1 else ''} {{ public static void go(Integer a) {{ C{(i + 1) % n}.go(1); helper(); List<Account> x = [SELECT Id, Owner{i}__r.Name FROM Account]; }} static void helper() {{}} }}" for i in range(n)}
    for i in range(0, n, 5):
        made[f"objects/Account/fields/Owner{i}__c.field-meta.xml"] = f"<CustomField><fullName>Owner{i}__c</fullName><type>Lookup</type><referenceTo>User</referenceTo></CustomField>"
    made["objects/User/fields/Name.field-meta.xml"] = "<CustomField><fullName>Name</fullName><type>Text</type></CustomField>"
    return made | changed


def test_only_affected_references_are_resolved(spark, tmp_path):
    """Each edit ends in the graph and the file pairs of a full run, and resolves no more than what it can affect."""
    n, root = 20, tmp_path / "t"
    write(root, peers(n))
    index, counts = index_project(Index.empty(spark), str(root), at=1)
    everything = counts["references_resolved"]
    base = root / "force-app/main/default"
    new_method = "public class C4 extends C3 { public static void go(Integer a) { C5.go(1); } public static void go(Integer b, Integer c) {} public static void go(Integer d) {} }"
    edits = [
        ({"classes/C4.cls": new_method}, [], 10),  # an overload more: its callers are ambiguous now
        ({"classes/C4.cls": new_method + " // a comment"}, [], 6),  # nothing that others can see
        ({}, ["classes/C9.cls"], 3),  # gone: C8 calls it, C10 extends it
        ({"classes/C9.cls": peers(n)["classes/C9.cls"]}, [], 12),  # back
        ({"objects/Account/fields/Owner7__c.field-meta.xml": peers(n)["objects/Account/fields/Owner5__c.field-meta.xml"].replace("Owner5", "Owner7")}, [], 4),  # a path that leads on
        ({}, ["objects/User/fields/Name.field-meta.xml"], 65),
    ]
    for at, (put, gone, most) in enumerate(edits, 2):
        write(root, put)
        for g in gone:
            (base / g).unlink()
        index, counts = index_project(index, str(root), at=at)
        assert counts["files_parsed"] == len(put) and counts["files_removed"] == len(gone)
        full, _ = index_project(Index.empty(spark), str(root), "full", at=at)
        assert graph_facts(index.graph) == graph_facts(full.graph), at
        pairs = [sorted((r["target_file"], r["referring_file"]) for r in x.graph.file_backrefs.collect()) for x in (index, full)]
        assert pairs[0] == pairs[1]
        for table, key in (("links", "edge_id"), ("lookups", "key"), ("records", "text")):
            a, b = (getattr(x, table) for x in (index, full))
            assert a.count() == b.count() and a.select(key).distinct().count() == b.select(key).distinct().count()
        assert 0 < counts["references_resolved"] <= most < everything / 2, (at, counts["references_resolved"], everything)
    assert index.graph.edges.select("id").distinct().count() == index.graph.edges.count()


def test_watch(spark, tmp_path):
    root, store = write(tmp_path / "w", {"classes/Base.cls": TREE["classes/Base.cls"]}), str(tmp_path / "store")
    query = ingest.watch(spark, store, root, str(tmp_path / "ck"))
    try:
        def until(n, tries=240):
            import time

            for _ in range(tries):
                if query.exception():
                    raise query.exception()
                index = Index.load(spark, store)
                if index.graph.nodes.where("label = 'ApexClass'").count() == n:
                    return True
                time.sleep(0.5)
            return False

        assert until(1)
        write(tmp_path / "w", {"classes/Other.cls": TREE["classes/Other.cls"]})
        assert until(2)
    finally:
        query.stop()
    assert diff.changes(Index.load(spark, store).graph, 1, 1).count() == 0
