"""Contracts as data: column names, classes, recommendations and the stand-in model."""

from __future__ import annotations

import re

# fixed values: model classes, by class id
CLASSES = (
    "API", "Benign", "Bruteforce", "BufferOverflow", "C2Beaconing", "DDoS", "DNS", "DoS", "Evasion", "Exfiltration", "Exploitation", "MITM",
    "PortScan", "Slowloris", "TLSSSL", "WebBased",
)

# fixed values: model features, in model order
FEATURES = (
    "ACK Flag Count", "Active Max", "Active Mean", "Active Min", "Active Std", "Average Packet Size", "Bwd Bulk Rate Avg", "Bwd Bytes/Bulk Avg",
    "Bwd Header Length", "Bwd IAT Max", "Bwd IAT Mean", "Bwd IAT Min", "Bwd IAT Std", "Bwd IAT Total", "Bwd Init Win Bytes", "Bwd PSH Flags",
    "Bwd Packet Length Max", "Bwd Packet Length Mean", "Bwd Packet Length Min", "Bwd Packet Length Std", "Bwd Packet/Bulk Avg",
    "Bwd Segment Size Avg", "Bwd URG Flags", "CWR Flag Count", "Down/Up Ratio", "Dst Port", "ECE Flag Count", "FIN Flag Count", "FWD Init Win Bytes",
    "Flow Bytes/s", "Flow Duration", "Flow IAT Max", "Flow IAT Mean", "Flow IAT Min", "Flow IAT Std", "Flow Packets/s", "Fwd Bulk Rate Avg",
    "Fwd Bytes/Bulk Avg", "Fwd Header Length", "Fwd IAT Max", "Fwd IAT Mean", "Fwd IAT Min", "Fwd IAT Std", "Fwd IAT Total", "Fwd PSH Flags",
    "Fwd Packet Length Max", "Fwd Packet Length Mean", "Fwd Packet Length Min", "Fwd Packet Length Std", "Fwd Packet/Bulk Avg",
    "Fwd Segment Size Avg", "Fwd URG Flags", "Idle Max", "Idle Mean", "Idle Min", "Idle Std", "PSH Flag Count", "Packet Length Max",
    "Packet Length Mean", "Packet Length Min", "Packet Length Std", "Packet Length Variance", "Protocol", "RST Flag Count", "SYN Flag Count",
    "Subflow Bwd Bytes", "Subflow Bwd Packets", "Subflow Fwd Bytes", "Subflow Fwd Packets", "Total Bwd packets", "Total Fwd Packet",
    "Total Length of Bwd Packet", "Total Length of Fwd Packet", "URG Flag Count",
)

# fixed values: what to do about a predicted class
RECOMMENDATIONS = {
    "API": (
        'Review API-related activity for unusual request patterns, unauthorized access attempts, or abuse.',
        (
            'Review the source and destination involved in the detected API traffic.',
            'Check application and API gateway logs for matching timestamps.',
            'Verify whether the observed API requests were authorized.',
            'Inspect authentication failures, unusual request volume, and suspicious endpoints.',
            'Preserve relevant logs and network evidence for further investigation.',
        ),
    ),
    "Bruteforce": (
        'Repeated authentication attempts may indicate a brute-force attack.',
        (
            'Identify the source system generating repeated authentication attempts.',
            'Review authentication logs for repeated failures.',
            'Check whether any account was successfully accessed after repeated failures.',
            'Temporarily restrict or block the suspicious source if appropriate.',
            'Preserve authentication and network logs for correlation.',
        ),
    ),
    "BufferOverflow": (
        'The detected traffic may be associated with buffer overflow exploitation attempts.',
        (
            'Identify the targeted host and service.',
            'Review application and operating system logs for crashes or abnormal behavior.',
            'Check the affected service version for known vulnerabilities.',
            'Inspect related traffic around the detected flow.',
            'Preserve system memory, logs, and network evidence if compromise is suspected.',
        ),
    ),
    "C2Beaconing": (
        'Repeated communication patterns may indicate command-and-control beaconing.',
        (
            'Identify the internal system involved in the repeated communication.',
            'Review destination IP addresses and domains.',
            'Check for periodic or repeated outbound connections.',
            'Correlate the activity with endpoint and DNS logs.',
            'Consider isolating the affected host if compromise is confirmed.',
        ),
    ),
    "DDoS": (
        'The traffic pattern may represent distributed denial-of-service activity.',
        (
            'Identify the targeted host or service.',
            'Review traffic volume and source distribution.',
            'Check firewall and network device logs.',
            'Identify whether multiple source addresses participated in the activity.',
            'Preserve traffic evidence for timeline reconstruction.',
        ),
    ),
    "DNS": (
        'The detected traffic contains suspicious DNS-related behavior.',
        (
            'Review the queried domains and responding DNS servers.',
            'Check for unusually frequent or abnormal DNS requests.',
            'Correlate suspicious domains with endpoint activity.',
            'Inspect DNS logs for related systems.',
            'Preserve DNS and network logs for further analysis.',
        ),
    ),
    "DoS": (
        'The traffic pattern may indicate denial-of-service activity against a host or service.',
        (
            'Identify the targeted host and service.',
            'Review connection rate and packet volume.',
            'Check firewall and server logs for service disruption.',
            'Identify the source of the traffic.',
            'Preserve relevant PCAP and system logs for investigation.',
        ),
    ),
    "Evasion": (
        'The detected traffic may contain behavior intended to avoid normal security inspection.',
        (
            'Review unusual packet and flow characteristics.',
            'Compare the activity with firewall and IDS alerts.',
            'Inspect related sessions from the same source.',
            'Check for fragmentation, unusual ports, or protocol anomalies.',
            'Preserve the original traffic capture for deeper inspection.',
        ),
    ),
    "Exfiltration": (
        'The detected traffic may indicate unauthorized data transfer.',
        (
            'Identify the source and destination systems.',
            'Review the amount and direction of transferred data.',
            'Check whether the destination is approved or expected.',
            'Correlate the activity with endpoint and user logs.',
            'Preserve network and host evidence before containment actions.',
        ),
    ),
    "Exploitation": (
        'The detected traffic may represent an attempt to exploit a vulnerable service.',
        (
            'Identify the targeted host, port, and service.',
            'Review vulnerability information for the affected service.',
            'Check system and application logs for exploitation indicators.',
            'Inspect surrounding network flows for follow-up activity.',
            'Preserve relevant host and network evidence.',
        ),
    ),
    "MITM": (
        'The traffic may indicate man-in-the-middle behavior.',
        (
            'Review the affected source and destination systems.',
            'Inspect ARP, DNS, and certificate-related anomalies.',
            'Check for unexpected gateway or routing changes.',
            'Compare traffic with trusted network configuration.',
            'Preserve network evidence for further validation.',
        ),
    ),
    "PortScan": (
        'The detected flow may indicate systematic scanning of network ports.',
        (
            'Identify the system performing the scan.',
            'Review the destination hosts and ports contacted.',
            'Determine whether the scanning activity was authorized.',
            'Check firewall and IDS logs for additional scanning activity.',
            'Preserve the related network flows for timeline analysis.',
        ),
    ),
    "Slowloris": (
        'The detected behavior may indicate a Slowloris-style denial-of-service attempt.',
        (
            'Identify the targeted web server or service.',
            'Review long-lived or incomplete connections.',
            'Check server logs for connection exhaustion.',
            'Review connection limits and timeout settings.',
            'Preserve the relevant network and server logs.',
        ),
    ),
    "TLSSSL": (
        'The traffic contains TLS/SSL behavior that requires additional review.',
        (
            'Review the systems involved in the encrypted connection.',
            'Check certificate information and destination reputation.',
            'Inspect metadata such as connection frequency and destination ports.',
            'Correlate the activity with endpoint and application logs.',
            'Preserve the encrypted traffic metadata for investigation.',
        ),
    ),
    "WebBased": (
        'The detected traffic may indicate a web-based attack.',
        (
            'Identify the targeted web application and endpoint.',
            'Review web server and application logs.',
            'Inspect request patterns associated with the detected flow.',
            'Check whether the activity resulted in unauthorized access or application errors.',
            'Preserve network and application evidence.',
        ),
    ),
    "Benign": (
        'The flow was classified as benign and does not currently require threat-response action.',
        (
            'Retain the flow as part of the forensic case record.',
            'Correlate with surrounding flows if it is relevant to the incident timeline.',
            'Do not treat the classification alone as proof that the activity is harmless.',
        ),
    ),
}

BENIGN = "Benign"
DECISIONS = ("Confirmed", "Rejected", "Inconclusive")
METADATA = ("Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp")


def snake(name: str) -> str:
    """A feature's name as a column name: `Flow Bytes/s` is flow_bytes_s."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip("\ufeff \t\r\n").lower()).strip("_")


COLUMNS = tuple(snake(f) for f in FEATURES)
PACKETS = (
    "case_id string, packet_number long, timestamp timestamp, source_ip string, destination_ip string, protocol string, protocol_number int, "
    "source_port int, destination_port int, packet_length long, tcp_flags string, header_length int, payload_length long, tcp_window int"
)

REVIEWS = "case_id string, flow_index long, predicted_class string, decision string, notes string, review_timestamp timestamp"

#: The stand-in linear model: (feature, mean, scale) by feature id, a rule for weights, and biases.
STAND_IN = (
    ("Flow Duration", 4.0e10, 2.5e10), ("Packet Length Mean", 120.0, 50.0), ("Packet Length Max", 180.0, 90.0),
    ("Total Fwd Packet", 2.0, 2.0), ("SYN Flag Count", 0.7, 0.8), ("Total Length of Fwd Packet", 300.0, 250.0),
)


def weight(c: int, f: int) -> float:
    return ((c * 7 + f * 13 + c * f * 3) % 11 - 5) / 10.0


def bias(c: int) -> float:
    return 0.8 if CLASSES[c] == BENIGN else 0.0


# fixed values: sentences of reports; %1$d reviews, %2$d threats, %3$d unreviewed
REPORT_STATUS = {
    "none": "Report loaded successfully. No threat flows were identified.",
    "all": "Report loaded successfully. All %2$d detected threat flows have investigator reviews.",
    "some": "Report loaded successfully. %1$d of %2$d detected threat flows have investigator reviews. %3$d remain unreviewed.",
}
# fixed values: sentences on a prediction
HEADLINE = {
    "none": "The model classified this flow as %s with %s confidence, but no SHAP contributors were available.",
    "some": 'The model classified this network flow as %s with %s confidence. The strongest SHAP contributor was "%s". Its observed value %s the predicted class. The table below lists the most influential features for this prediction.',
}
# fixed values: sentences of a narration
NARRATION = {
    "start": "The XGBoost classifier predicted '%s'.", "yes": "The strongest TreeSHAP features supporting this prediction were %s.", "no": "Features that opposed the prediction included %s.",
    "empty": " No TreeSHAP feature contributions were available for natural-language explanation.",
}
