"""Classification of calls and definitions by ordered rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import normalize_route

# Patterns of callees by what they do; the first that matches counts.
CALLS = {
    "ipc-client": r"^(invoke|tauri\.invoke|ipcRenderer\.(invoke|send)|window\.__TAURI__\.\w+\.invoke)$",
    "ipc-server": r"^(ipcMain\.(handle|on)|listen)$",
    "http-server": r"^((app|router|r|api|server|srv|mux|e|g|group|route|blueprint|bp)\.(get|post|put|patch|delete|head|options|route|all|use|handle|handle_func|HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|Any|Group)|http\.(HandleFunc|Handle)|.*\.route|web::(get|post|put|patch|delete|resource|scope)|(web::)?scope)$",
    "http-client": r"^(fetch|window\.fetch|globalThis\.fetch|(axios|ky|got|superagent|api|client|http|httpx|session|requests|urllib\.request|this\.http|this\.client|self\.client|self\.session)\.(get|post|put|patch|delete|request|fetch|head|urlopen)|axios|ky|http\.(Get|Post|Head|NewRequest|PostForm)|client\.Do|http\.DefaultClient\.Do|reqwest::(blocking::)?(get|post|Client::new)|.*\.send|ureq::(get|post)|urlopen)$",
    "db": r"(?i)^(sqlx::(query|query_as|query_scalar)!?|.*\.(execute|fetch_one|fetch_all|fetch_optional|query_row|prepare)|(db|conn|pool|tx|cursor|session|client|prisma|knex|sequelize|mongoose|mongo|collection|redis|sql|orm)\.(query|exec|execute|fetch|fetchall|fetchone|find|find_one|findOne|findMany|insert|insert_one|insertOne|update|updateOne|delete|deleteOne|save|create|aggregate|raw|select|from|Query|QueryRow|Exec|Prepare|First|Find|Create|Save|Delete|Where)|gorm\.Open|sql\.Open|sqlx\.Connect|sqlx::.*::connect|create_engine|psycopg2\.connect|sqlite3\.connect|pymongo\.MongoClient|MongoClient|createConnection|createPool|PrismaClient|diesel::.*|rusqlite::Connection::open)$",
    "env": r"^((std::)?env::(var|var_os|vars)|env::var|os\.(Getenv|LookupEnv|environ\.get|getenv)|os\.environ\.get|getenv|dotenv|dotenv\.config|dotenv::dotenv|load_dotenv|env!|option_env!|std::env::var)$",
    "fs": r"^((std::)?fs::(read|read_to_string|write|create_dir|create_dir_all|remove_file|remove_dir_all|copy|rename|File::open|File::create|read_dir)|File::(open|create)|.*\.write_all|fs\.(readFile|readFileSync|writeFile|writeFileSync|readdir|readdirSync|mkdir|mkdirSync|unlink|rm|stat|createReadStream|createWriteStream|promises\.\w+)|(fs\.promises|fsp|fsPromises)\.\w+|(Path|pathlib\.Path|path)\.(read_text|write_text|read_bytes|write_bytes|open|iterdir|glob)|os\.(Open|Create|ReadFile|WriteFile|ReadDir|Remove|Mkdir|MkdirAll|Stat)|ioutil\.(ReadFile|WriteFile|ReadDir)|filepath\.Walk|shutil\.\w+|tokio::fs::\w+)$",
    "queue": r"(?i)^((producer|consumer|channel|ch|kafka|broker|queue|bus|nats|nc|js|sqs|pubsub|topic|subscriber|publisher|redis|rdb|client)\.(publish|subscribe|send|send_message|sendMessage|consume|produce|emit|basic_publish|basic_consume|Publish|Subscribe|SendMessage|ReceiveMessage|xadd|xread|lpush|rpush|brpop|blpop)|(celery|task|job)\.(delay|apply_async|enqueue)|\w+\.delay|\w+\.apply_async)$",
    "process": r"^((std::process::)?Command::new|tokio::process::Command::new|subprocess\.(run|Popen|call|check_output|check_call)|os\.system|exec\.Command|exec\.CommandContext|(child_process\.)?(spawn|exec|execSync|spawnSync|execFile|fork))$",
}
# How decorators and attributes mark routes and commands.
ROUTE_MARK = r"(?i)(?:^|[\[.@])(?:get|post|put|patch|delete|head|options|route|api_route|websocket|all)\s*\(\s*[\"'`]([^\"'`]*)[\"'`]"
COMMAND_MARK = r"tauri::command|^command\b|#\[command"


def call_class(callee: Column, lang: Column, strings: Column) -> Column:
    """The first rule that applies to a call, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CALLS.items()):
        good = callee.rlike(pattern)
        if name == "ipc-server":
            good = good & lang.isin("typescript", "javascript")
        if name == "http-server":
            good = good & F.coalesce(F.get(strings, F.lit(0)).startswith("/"), F.lit(False))
        if name == "fs":
            good = good | ((callee == "open") & (lang == "python"))
        out = F.when(good, name).otherwise(out)
    return out


def call_tags(kind: Column, strings: Column) -> Column:
    """Tags of a classified call; servers' tags go to their handlers and not here, but for the route."""
    first = F.get(strings, F.lit(0))
    routes = F.filter(F.transform(strings, normalize_route), lambda x: x.isNotNull())
    key = (
        F.when(kind == "ipc-client", F.concat(F.lit("ipc:"), first)).when(kind == "http-server", F.concat(F.lit("route:"), normalize_route(first))).when(kind == "http-client", F.concat(F.lit("route:"), F.get(routes, F.lit(0))))
        .when((kind == "env") & first.rlike(r"^[A-Z0-9_]+\z"), F.concat(F.lit("env:"), first)).when(kind == "queue", F.concat(F.lit("topic:"), first))
    )
    return F.array_compact(F.array(kind, key))


def call_binding(kind: Column, strings: Column) -> Column:
    """The key that a call registers a handler under, or null."""
    first = F.get(strings, F.lit(0))
    return F.when(kind == "ipc-server", F.concat(F.lit("ipc:"), first)).when(kind == "http-server", F.concat(F.lit("route:"), normalize_route(first)))


def mark_bindings(attrs: Column, name: Column) -> Column:
    """Keys that a definition's decorators or attributes register it under."""
    leaf = F.regexp_extract(name, r"([^:.]*)$", 1)
    ipc = F.transform(F.filter(attrs, lambda a: a.rlike(COMMAND_MARK)), lambda a: F.concat(F.lit("ipc:"), leaf))
    routes = F.transform(F.filter(attrs, lambda a: a.rlike(ROUTE_MARK)), lambda a: F.concat(F.lit("route:"), normalize_route(F.regexp_extract(a, ROUTE_MARK, 1))))
    return F.array_compact(F.concat(ipc, routes))
