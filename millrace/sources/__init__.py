"""Tables, catalogs and file scans."""
