"""Schemas of the tables this engine reads and writes; nothing is inferred."""

from __future__ import annotations

TABLES = {
    "nets": "board_id string, net_ord long, net_id long, net_name_raw string, net_name_canonical string, aliases array<string>, pins_raw array<string>, pins array<struct<token:string,refdes:string,pin:string>>",
    "component_pins": "board_id string, refdes string, image_name string, all_pins array<string>, connected_pins array<string>, floating_pins array<string>",
    "bom_lines": "board_id string, line_ord long, designators array<string>, quantity string, value string, manufacturer string, part_number string, note string, specification string, footprint string",
    "refdes_to_part": "board_id string, refdes string, part_number string, manufacturer string, value string, footprint string, specification string, datasheet_candidates array<string>",
    "pdf_chunks": "chunk_id string, source_type string, source_file string, page_start int, page_end int, heading_path array<string>, part_number_candidates array<string>, tokens array<string>, text string",
    "datasheet_markdown": "source_file string, markdown string",
    "component_facts": "board_id string, refdes string, part_number string, manufacturer string, source_file string, part_description string, has_pin_table boolean",
    "component_pin_functions": "board_id string, refdes string, part_number string, pin_name string, description string, function string, raw_row string",
    "power_domains": "board_id string, net_id long, domain_id string, net_name string, pin_count int, category string",
    "interface_buses": "board_id string, bus_type string, nets array<string>",
    "function_blocks": "board_id string, block string, component_refs array<string>, nets array<string>",
    "anomalies": "board_id string, anomaly_id string, severity string, kind string, refdes string, net_name string, pins string, n int",
    "typed_graph": "board_id string, src string, dst string, relation string, pin string",
    "graph_edges": "board_id string, net_ord long, net_id long, pin_ord int, edge_no int, src string, dst string, type string",
    "sheet_semantics": "source_file string, page_number int, sheet_hints array<string>, debug boolean, power boolean, sensor boolean, connector boolean",
    "page_images": "source_file string, page_number int, width int, height int, image binary",
    "protocol_obligations": "protocol string, required_nets array<string>, note string",
    "entity_pages": "net_name string, source_file string, page_number int",
}
