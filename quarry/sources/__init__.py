"""Tables: discovery, footers, zone maps and scans."""
