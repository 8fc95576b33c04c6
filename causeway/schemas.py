"""Table schemas of the trace model."""

STEPS = (
    "run_id string, step long, ts timestamp, file string, line int, code string, func string, "
    "depth int, call_id long, indent int, block_id long, reads array<string>, writes array<string>"
)
SNAPSHOTS = (
    "run_id string, step long, var string, value string, type string, memory_id long, "
    "container_keys array<string>"
)
BLOCKS = "run_id string, block_id long, parent_block_id long, indent int, condition_step long"
CALLS = (
    "run_id string, call_id long, parent_call_id long, func string, caller_step long, "
    "callee_first_step long, return_step long, depth int, start_line int, end_line int, "
    "args map<string,struct<value:string,type:string,memory_id:long>>, "
    "return_value struct<value:string,type:string,memory_id:long>"
)
EDGES = (
    "run_id string, src long, dst long, kind string, var string, src_version int, "
    "dst_version int, metadata map<string,string>"
)
#: A fact with more evidence than one chunk of steps continues in rows with
#: ``part`` above 0; all other columns repeat.
FACTS = (
    "run_id string, fact_id string, kind string, subject string, description string, evidence array<long>, "
    "part long, confidence double, metadata map<string,string>"
)
CNODES = (
    "graph_id string, node_id string, file_path string, line_number int, code_content string, "
    "node_type string, semantic_label string"
)
CEDGES = "graph_id string, src string, dst string, edge_type string, props map<string,string>"
HEAP_OBJECTS = "run_id string, step long, obj_id long, type string, value string, attrs map<string,string>"
HEAP_REFS = "run_id string, step long, obj_id long, attr string, target_id long"

#: One step as a recorder dumps it: a row per executed line.
STEP_JSON = (
    "run_id string, index long, file string, line int, code string, func string, "
    "vars map<string,struct<value:string,type:string,memory_id:long>>, changed array<string>, "
    "new_vars array<string>, mutated array<string>, rebound array<string>, depth int, indent int, "
    "block_id long, call_id long, ast_reads array<string>, ast_writes array<string>, "
    "ssa_versions map<string,int>"
)
