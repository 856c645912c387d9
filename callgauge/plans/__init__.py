"""Reports and the hourly rollup over the call table."""
