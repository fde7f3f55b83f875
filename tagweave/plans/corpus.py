"""Small sources, one for each language, for extraction queries and tests."""

SNIPPETS = {
    "cpp": ("src/geo/calc.cpp", "int add(int a, int b) {\n  return a + b;\n}\n\nclass Calculator : public Base {\npublic:\n  int multiply(int x, int y) {\n    return x * y;\n  }\n  void reset() const;\n};\n\nvoid Calculator::reset() const { if (ok) { run(); } }\n"),
    "java": ("app/net/Client.java", "package demo.net;\n\npublic class HttpClient extends Base implements Closeable {\n    public int open(String url) throws IOException {\n        return 1;\n    }\n}\n"),
    "js": ("web/store.ts", "export default class TagStore extends Store {\n}\nexport async function loadTags(url) {\n}\nconst pick = async (x) => x;\n"),
    "python": ("pkg/tools/run.py", "class A:\n    x=1\n\n\ndef top():\n    pass\n\n@cached\nasync def fetch(url: str) -> bytes:\n    return b''\n"),
    "go": ("cmd/srv/main.go", "package srv\n\ntype Server struct {\n}\n\nfunc (s *Server) Serve(addr string) error {\n\treturn nil\n}\n"),
    "rust": ("crates/io/lib.rs", "pub struct Reader;\nenum Kind { A }\npub async fn read_all<T>(r: T) -> usize {\n    0\n}\n"),
    "ruby": ("lib/user.rb", "class User < Record\n  def self.find(id)\n  end\n  def name\n  end\nend\n"),
    "php": ("inc/Repo.php", "<?php\nnamespace App\\Data;\nfinal class Repo extends Base implements Countable {\n  public function count(): int {\n    return 0;\n  }\n}\n"),
    "csharp": ("src/Core/Job.cs", "namespace Acme.Core {\npublic class Job : IJob {\n  public async Task Run(int n) {\n  }\n}\n}\n"),
    "bash": ("bin/deploy.sh", "#!/bin/sh\nfunction push_all() {\n  echo x\n}\nclean() {\n  rm -r x\n}\n"),
}

#: One source file for each part, by language: extension, text, and the symbols that are in it: id, kind, signature,
#: declaration line, implementation line and snippet. {k} is the part's key and {z} its size.
GENERATED = {
    "cpp": ("cpp", "// part {k}\nint get_{k}(int a) {\n  return a + {z};\n}\nclass Part{k} {\npublic:\n  void run(int n);\n};\n", [
        ("get_{k}", "function", "int get_{k}(int a)", None, 2, "int get_{k}(int a) {\n  return a + {z};\n}"), ("Part{k}", "class", "class Part{k} ", 5, None, None), ("Part{k}::run", "function", "void Part{k}::run(int n)", 7, None, None)]),
    "java": ("java", "package gen;\npublic class Part{k} extends Base {\n    public int get{k}(int a) {\n        return a + {z};\n    }\n}\n", [
        ("gen.Part{k}", "class", "public class Part{k} extends Base", 2, None, "{\n    public int get{k}(int a) {\n        return a + {z};\n    }\n}"), ("gen.Part{k}.get{k}", "function", "public int get{k}(int a)", 3, None, "{\n        return a + {z};\n    }")]),
    "js": ("ts", "export class Part{k} extends Base {\n}\nexport function get{k}(a) {\n  return a + {z};\n}\n", [
        ("Part{k}", "class", "export class Part{k} extends Base", 1, None, "{\n}"), ("get{k}", "function", "export function get{k}(a)", 3, None, "{\n  return a + {z};\n}")]),
    "python": ("py", "class Part{k}:\n    def get_{k}(self, a):\n        return a + {z}\n", [
        ("Part{k}", "class", "class Part{k}", 1, None, None), ("Part{k}.get_{k}", "function", "def get_{k}(self, a)", 2, None, "return a + {z}")]),
    "go": ("go", "package gen\n\ntype Part{k} struct {\n}\n\nfunc (p *Part{k}) Get(a int) int {\n\treturn a + {z}\n}\n", [
        ("gen.Part{k}", "class", "type Part{k} struct", 3, None, "{\n}"), ("gen.Part{k}.Get", "function", "func (p *Part{k}) Get(a int) int", 6, None, "{\n\treturn a + {z}\n}")]),
    "rust": ("rs", "pub struct Part{k} {\n}\npub fn get_{k}(a: u32) -> u32 {\n    a + {z}\n}\n", [
        ("Part{k}", "class", "pub struct Part{k}", 1, None, "{\n}"), ("get_{k}", "function", "pub fn get_{k}(a: u32) -> u32", 3, None, "{\n    a + {z}\n}")]),
    "ruby": ("rb", "class Part{k} < Base\n  def get_{k}(a)\n    a + {z}\n  end\nend\n", [
        ("Part{k}", "class", "class Part{k} < Base", 1, None, None), ("Part{k}::get_{k}", "function", "def get_{k}(a)", 2, None, "a + {z}")]),
    "php": ("php", "<?php\nclass Part{k} extends Base {\n  public function get{k}($a) {\n    return $a + {z};\n  }\n}\n", [
        ("Part{k}", "class", "class Part{k} extends Base", 2, None, "{\n  public function get{k}($a) {\n    return $a + {z};\n  }\n}"), ("get{k}", "function", "public function get{k}($a)", 3, None, "{\n    return $a + {z};\n  }")]),
    "csharp": ("cs", "namespace Gen {\npublic class Part{k} : Base {\n  public int Get{k}(int a) {\n    return a + {z};\n  }\n}\n}\n", [
        ("Gen.Part{k}", "class", "public class Part{k} : Base", 2, None, "{\n  public int Get{k}(int a) {\n    return a + {z};\n  }\n}"), ("Get{k}", "function", "public int Get{k}(int a)", 3, None, "{\n    return a + {z};\n  }")]),
    "bash": ("sh", "#!/bin/sh\nget_{k}() {\n  echo {z}\n}\n", [("get_{k}", "function", "get_{k}()", 2, None, "echo {z}")]),
}
