"""Word lists and alias table of tag normalization. Results depend on every entry."""

from __future__ import annotations

# fmt: off
# Tags that are dropped on index normalization.
STOP_WORDS = (
    "return", "void", "null", "undefined", "class", "struct", "interface", "impl", "function", "method", "default", "true", "false", "const", "let",
    "var", "static", "public", "private", "protected", "abstract", "virtual", "override", "final", "new", "delete", "this", "self", "super",
    "extends", "implements", "get", "set", "do", "run", "make", "create", "build", "handle", "process", "execute", "call", "invoke", "apply", "use",
    "main", "start", "stop", "init", "exit", "end", "begin", "open", "close", "load", "save", "read", "write", "input", "output", "data", "value",
    "result", "item", "element", "node", "list", "array", "map", "object", "string", "number", "integer", "boolean", "type", "name", "id", "key",
    "index", "count", "size", "length", "info", "state", "status", "flag", "option", "options", "param", "params", "arg", "args", "temp", "tmp",
    "test", "debug", "log", "print", "foo", "bar", "baz", "example", "sample", "demo", "todo", "fixme", "hack", "note", "xxx", "src", "lib", "dist",
    "out", "bin", "core", "common", "shared", "base", "utils", "util", "helper", "helpers", "internal", "detail", "details",
)

# Aliases that are always applied.
HARD_ALIASES = {
    "str": "string", "int": "integer", "num": "number", "bool": "boolean", "arr": "array", "obj": "object", "dict": "dictionary", "vec": "vector",
    "ptr": "pointer", "ref": "reference", "char": "character", "db": "database", "repo": "repository", "config": "configuration",
    "cfg": "configuration", "conf": "configuration", "env": "environment", "var": "variable", "vars": "variables", "param": "parameter",
    "params": "parameters", "arg": "argument", "args": "arguments", "attr": "attribute", "attrs": "attributes", "prop": "property",
    "props": "properties", "err": "error", "errs": "errors", "warn": "warning", "msg": "message", "msgs": "messages", "req": "request",
    "reqs": "requests", "res": "response", "resp": "response", "ctx": "context", "fn": "function", "func": "function", "cb": "callback",
    "evt": "event", "evts": "events", "cmd": "command", "cmds": "commands", "op": "operation", "ops": "operations", "http": "http", "https": "https",
    "ws": "websocket", "wss": "websocket", "tcp": "tcp", "udp": "udp", "api": "api", "rest": "rest_api", "rpc": "rpc", "grpc": "grpc", "url": "url",
    "uri": "uri", "dns": "dns", "ip": "ip_address", "auth": "authentication", "authn": "authentication", "authz": "authorization", "oauth": "oauth",
    "jwt": "jwt", "token": "token", "cred": "credential", "creds": "credentials", "pwd": "password", "passwd": "password", "json": "json",
    "xml": "xml", "yaml": "yaml", "yml": "yaml", "csv": "csv", "html": "html", "css": "css", "js": "javascript", "ts": "typescript", "py": "python",
    "rb": "ruby", "cpp": "cpp", "cxx": "cpp", "sql": "sql", "nosql": "nosql", "mongo": "mongodb", "mysql": "mysql", "postgres": "postgresql",
    "pg": "postgresql", "redis": "redis", "sqlite": "sqlite", "orm": "orm", "fs": "filesystem", "file": "file", "dir": "directory",
    "dirs": "directories", "path": "path", "io": "io", "async": "async", "sync": "sync", "await": "await", "thread": "thread", "threads": "threads",
    "mutex": "mutex", "lock": "lock", "sem": "semaphore", "chan": "channel", "cond": "condition", "mem": "memory", "alloc": "allocation",
    "dealloc": "deallocation", "gc": "garbage_collection", "heap": "heap", "stack": "stack", "buf": "buffer", "cache": "cache",
    "spec": "specification", "specs": "specifications", "mock": "mock", "stub": "stub", "fake": "fake", "assert": "assertion",
    "expect": "expectation", "doc": "documentation", "docs": "documentation", "ver": "version", "vers": "versions", "max": "maximum",
    "min": "minimum", "avg": "average", "len": "length", "cnt": "count", "idx": "index", "pos": "position", "src_file": "source",
    "dst": "destination", "dest": "destination", "prev": "previous", "curr": "current", "next": "next", "配置": "configuration", "请求": "request",
    "响应": "response", "错误": "error", "缓存": "cache", "数据库": "database", "文件": "file", "网络": "network", "认证": "authentication", "授权": "authorization",
}

# Words that semantic tags may not be.
SEMANTIC_STOP_WORDS = (
    "get", "set", "do", "run", "ctx", "impl", "mgr", "mgrs", "util", "utils", "helper", "helpers", "src", "core", "server", "client", "common",
    "base", "async", "await", "sync", "promise", "promises", "callback", "callbacks", "try", "catch", "try_catch", "module", "modules", "config",
    "configuration", "method", "methods", "post", "put", "delete", "request", "response", "header", "headers", "body", "http", "api", "url", "uri",
    "query", "params", "service", "handler", "handlers", "manager", "managers", "data",
)

# Words that base tags of a language may not be.
BASE_STOP_WORDS = {
    "cpp": (
        "get", "set", "do", "run", "ctx", "impl", "mgr", "mgrs", "util", "utils", "helper", "helpers", "src", "core", "server", "client", "common",
        "base",
    ),
    "java": (
        "get", "set", "do", "run", "ctx", "impl", "mgr", "mgrs", "util", "utils", "helper", "helpers", "src", "core", "server", "client", "common",
        "base", "main", "app",
    ),
    "python": (
        "get", "set", "do", "run", "ctx", "impl", "mgr", "mgrs", "util", "utils", "helper", "helpers", "src", "core", "server", "client", "common",
        "base", "main", "app",
    ),
    "js": (
        "get", "set", "do", "run", "ctx", "impl", "mgr", "mgrs", "util", "utils", "helper", "helpers", "src", "core", "server", "client", "common",
        "base", "main", "app", "index",
    ),
    "go": (
        "get", "set", "do", "run", "ctx", "impl", "mgr", "mgrs", "util", "utils", "helper", "helpers", "src", "core", "server", "client", "common",
        "base", "main", "app", "cmd", "pkg",
    ),
    "rust": (
        "mod", "pub", "use", "crate", "self", "super", "src", "lib",
    ),
    "ruby": (
        "def", "end", "class", "module", "self", "attr", "require", "lib",
    ),
    "php": (
        "php", "use", "namespace", "public", "private", "protected", "function",
    ),
    "csharp": (
        "get", "set", "using", "system", "namespace", "var", "public", "private",
    ),
    "bash": (
        "bin", "bash", "sh", "zsh", "usr", "local", "env",
    ),
}
# fmt: on
