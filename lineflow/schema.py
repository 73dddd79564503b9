"""Row types of the engine and the fixed vocabularies they use."""

# --- Fixed values -----------------------------------------------------------------------
NODE_KINDS = (
    "ENTRY", "EXIT", "ASSIGN", "CALL", "BRANCH", "LOOP", "SWITCH", "RETURN", "JUMP", "DECL", "OTHER",
)
KIND_PRIORITY = (
    "ENTRY", "EXIT", "BRANCH", "LOOP", "SWITCH", "RETURN", "JUMP", "ASSIGN", "CALL", "DECL", "OTHER",
)
TERMINAL_KINDS = ("ENTRY", "EXIT")
SPLITS = ("train", "val", "test")
CANONICAL_COLUMNS = (
    "sample_id", "project", "commit_id", "cwe", "vul",
    "func_before", "func_after", "flaw_lines", "flaw_line_indices",
)
# ----------------------------------------------------------------------------------------

NODE_DDL = (
    "struct<id:int,line:int,kind:string,code:string,depth:int,in_loop:boolean,"
    "calls:array<string>,ops:array<string>>"
)
EDGE_DDL = "struct<u:int,v:int>"
GRAPH_DDL = (
    "sample_id string, project string, commit_id string, cwe string, source_lines array<string>,"
    f" nodes array<{NODE_DDL}>, edges array<{EDGE_DDL}>, back_edges array<{EDGE_DDL}>,"
    " entry int, exit int, vuln_nodes array<int>, features map<string,array<array<double>>>"
)
GRAPH_COLUMNS = (
    "sample_id", "project", "commit_id", "cwe", "source_lines", "nodes", "edges", "back_edges",
    "entry", "exit", "vuln_nodes", "features",
)

# The JSON form of a record writes an edge as a two-element array.
GRAPH_JSON_DDL = GRAPH_DDL.replace(f"array<{EDGE_DDL}>", "array<array<int>>")

METHOD_DDL = (
    "file string, name string, line int, line_end int,"
    " nodes array<struct<id:bigint,label:string,line:int,name:string,code:string>>,"
    " edges array<struct<src:bigint,dst:bigint>>,"
    " controls array<struct<type:string,line:int,first:int,last:int>>,"
    " stmts array<struct<label:string,first:int,last:int>>"
)
# Exported methods hold mixed-type tuples; read every cell as text, then cast.
METHOD_JSON_DDL = (
    "file string, name string, line int, line_end int, nodes array<array<string>>,"
    " edges array<array<bigint>>, controls array<array<string>>, stmts array<array<string>>"
)

EPISODE_DDL = (
    "method string, seed int, split string, graph_id string, project string, cwe string,"
    " num_nodes int, num_vuln int, dist_to_vuln int, max_steps int, success boolean,"
    " first_declare_correct boolean, nodes_inspected int, actions_taken int,"
    " cumulative_reward double, first_hit_step int, end_reason string"
)
EPISODE_COLUMNS = tuple(field.split()[0] for field in EPISODE_DDL.split(","))

STEP_DDL = (
    "struct<t:int,node:int,action:string,next_node:int,reward:double,"
    "mask:array<boolean>,probs:array<double>,value:double>"
)
TRACE_DDL = (
    f"graph_id string, method string, start_node int, steps array<{STEP_DDL}>,"
    " outcome struct<success:boolean,declared_node:int,return:double,end_reason:string,"
    "nodes_inspected:int>"
)
