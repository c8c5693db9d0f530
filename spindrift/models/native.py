"""The loops of tree growth, tree evaluation and the SVR solver on a JVM beside the Python worker.

They are compiled by Janino, which Spark brings along for its own code, from the source below; nothing else is needed
than the java and the jars of Spark. A worker starts its JVM (at most HEAP) when it first needs it; that ends with
the worker. Every sum is taken in the order of the numpy code in models.trees and models.estimators and every number drawn
from the same stream, so results are the same to the last bit with and without it (tested); only the time
differs. Where no JVM can be started, or with SPINDRIFT_NATIVE=0, numpy does the work.
"""

from __future__ import annotations

import os
import shutil
import struct
import subprocess
import tempfile
from pathlib import Path

import numpy as np

#: Heap of the JVM of a worker, and the most that it is given to grow trees on many rows, in MB.
HEAP, MOST_HEAP = 256, 1536
#: Most bytes of an SVR kernel matrix and nodes of trees that are sent there; numpy has the larger ones.
KERNEL, NODES = 96 << 20, 2_000_000
#: Most rows, most of their numbers and most columns in one evaluation; places of values take two bytes.
BLOCK, BLOCK_BYTES, WIDE = 1 << 15, 64 << 20, 1 << 15

_SOURCE = r"""
import java.io.*;
import java.nio.*;
import java.util.*;

public class Loops {
    static DataInputStream in = new DataInputStream(new BufferedInputStream(new FileInputStream(FileDescriptor.in), 1 << 16));
    static OutputStream out = new FileOutputStream(FileDescriptor.out);
    static byte[] chunk = new byte[1 << 18];

    static int count() throws IOException { return Integer.reverseBytes(in.readInt()); }
    static double[] doubles() throws IOException {
        double[] a = new double[count()];
        for (int at = 0; at < a.length; ) {
            int c = Math.min(a.length - at, chunk.length / 8);
            in.readFully(chunk, 0, c * 8);
            ByteBuffer.wrap(chunk, 0, c * 8).order(ByteOrder.LITTLE_ENDIAN).asDoubleBuffer().get(a, at, c);
            at += c;
        }
        return a;
    }
    static int[] ints() throws IOException {
        int[] a = new int[count()];
        for (int at = 0; at < a.length; ) {
            int c = Math.min(a.length - at, chunk.length / 4);
            in.readFully(chunk, 0, c * 4);
            ByteBuffer.wrap(chunk, 0, c * 4).order(ByteOrder.LITTLE_ENDIAN).asIntBuffer().get(a, at, c);
            at += c;
        }
        return a;
    }
    static long[] longs() throws IOException {
        int[] a = ints();
        long[] b = new long[a.length / 2];
        for (int i = 0; i < b.length; i++) b[i] = (a[2 * i] & 0xFFFFFFFFL) | ((long) a[2 * i + 1] << 32);
        return b;
    }
    static ByteBuffer room(int bytes) {
        ByteBuffer b = ByteBuffer.allocate(bytes + 4).order(ByteOrder.LITTLE_ENDIAN);
        return b;
    }
    static void put(double[] a, int n) throws IOException {
        ByteBuffer b = room(8 * n);
        b.putInt(n);
        for (int i = 0; i < n; i++) b.putDouble(a[i]);
        out.write(b.array());
    }
    static void put(int[] a, int n) throws IOException {
        ByteBuffer b = room(4 * n);
        b.putInt(n);
        for (int i = 0; i < n; i++) b.putInt(a[i]);
        out.write(b.array());
    }

    // the numbers of numpy's PCG64
    static long hi, lo, incHi, incLo;
    static final long MH = 0x2360ED051FC65DA4L, ML = 0x4385DF649FCCF645L;
    static double random() {
        long high = Math.multiplyHigh(lo, ML) + ((lo >> 63) & ML) + ((ML >> 63) & lo);
        long h = high + hi * ML + lo * MH, l = lo * ML, s = l + incLo;
        hi = h + incHi + (Long.compareUnsigned(s, l) < 0 ? 1 : 0);
        lo = s;
        return (Long.rotateRight(hi ^ lo, (int) (hi >>> 58)) >>> 11) * (1.0 / 9007199254740992.0);
    }

    // a matrix by columns; orders of the columns of many values; places where columns of two values hold the larger one
    static int n, width, MANY;
    static double[] x, ends;
    static int[] many, order, two, hotRow, hotCol;
    // x holds the columns that every row holds: slot is the number among them, or -1 - k for a category of feature k
    static int[] slot, codes;
    static double[][] sorted;  // values of the columns of many values, in order
    static char[][] near;  // and the place of each row's value among them; wide, where there are more
    static int[][] wide;
    static double at(int f, int r) {
        int s = slot[f];
        return s >= 0 ? x[s * n + r] : codes[(-1 - s) * n + r] == f ? 1.0 : 0.0;
    }

    static double l1, l2, minWeight;
    static double soft(double s) {
        if (l1 == 0) return s;
        double a = Math.abs(s) - l1;
        return a > 0 ? (s < 0 ? -a : a) : 0.0;
    }
    static double score(double s, double w) {
        double a = soft(s), b = w + l2;
        return a * a / (b > 1e-300 ? b : 1e-300);
    }
    // whether the scores of two sides surely add up to less; without division, and never true within rounding
    static boolean less(double a, double wa, double b, double wb, double than) {
        if (!(wa > 1e-30 && wb > 1e-30)) return false;
        a = soft(a); b = soft(b);
        return (a * a * wb + b * b * wa) * (1 + 1e-9) < than * (wa * wb);
    }
    static double value(double s, double w) {
        double b = w + l2;
        return soft(s) / (b > 1e-300 ? b : 1e-300);
    }

    static int[] feature, left, right;
    static double[] threshold, val, cover;
    static int size;
    static void add(double s, double w) {
        if (size == feature.length) {
            feature = Arrays.copyOf(feature, 2 * size); left = Arrays.copyOf(left, 2 * size); right = Arrays.copyOf(right, 2 * size);
            threshold = Arrays.copyOf(threshold, 2 * size); val = Arrays.copyOf(val, 2 * size); cover = Arrays.copyOf(cover, 2 * size);
        }
        feature[size] = left[size] = right[size] = -1;
        threshold[size] = 0;
        val[size] = value(s, w);
        cover[size++] = w;
    }

    static double[] cellG = new double[0], cellH = new double[0];
    static int[] cellC = new int[0], touched = new int[0];

    static double[] gain, cut, gl, hl;
    static int[] best, cl;

    // best splits of the m open nodes by one column of many values; sums go on over columns and nodes
    static double sg, sh;
    static void column(int c, int[] rows, int[] from, int m, boolean[] chosen, boolean random, double[] draws, double[] g, double[] h, double[] gt, double[] ht, int[] ct, int least) {
        int base = slot[c] * n;
        double[] x = Loops.x;
        double ag = sg, ah = sh;
        for (int a = 0; a < m; a++) {
            if (chosen != null && !chosen[a * width + c]) continue;
            int p = from[a], q = from[a + 1], all = ct[a];
            double g0 = ag, h0 = ah, ga = gt[a], ha = ht[a], whole = score(ga, ha), top = gain[a];
            double v = x[base + rows[p]];
            if (random) {
                double hiv = x[base + rows[q - 1]], at = v + (hiv - v) * draws[a];
                int t = 0;
                for (int i = p; i < q; i++) if (x[base + rows[i]] <= at) t++;
                double tg = 0, th = 0;
                for (int i = p; i < q; i++) {
                    ag += g[rows[i]]; ah += h[rows[i]];
                    if (i - p == t - 1) { tg = ag - g0; th = ah - h0; }
                }
                if (!(hiv > v) || t >= q - p || t < least || all - t < least) continue;
                if (minWeight != 0 && (th < minWeight || ha - th < minWeight)) continue;
                double won = score(tg, th) + score(ga - tg, ha - th) - whole;
                if (won > top) { gain[a] = won; best[a] = c; cut[a] = at; gl[a] = tg; hl[a] = th; cl[a] = t; }
                continue;
            }
            for (int i = p; i < q; i++) {
                int r = rows[i];
                ag += g[r]; ah += h[r];
                if (i + 1 == q) break;
                double next = x[base + rows[i + 1]];
                if (next > v) {
                    int tc = i + 1 - p;
                    if (tc >= least && all - tc >= least) {
                        double tg = ag - g0, th = ah - h0;
                        if ((minWeight == 0 || (th >= minWeight && ha - th >= minWeight)) && !less(tg, th + l2, ga - tg, ha - th + l2, top + whole)) {
                            double won = score(tg, th) + score(ga - tg, ha - th) - whole;
                            if (won > top) { top = won; gain[a] = won; best[a] = c; cut[a] = (v + next) / 2; gl[a] = tg; hl[a] = th; cl[a] = tc; }
                        }
                    }
                    v = next;
                }
            }
        }
        sg = ag; sh = ah;
    }

    // the same by the sums of each value: rows are the open ones, of the nodes own
    static double[] sumG = new double[0], sumH = new double[0];
    static int[] sumC = new int[0];
    static void sums(char[] place, int[] rows, int[] own, int used, int k, double[] g, double[] h) {
        double[] sumG = Loops.sumG, sumH = Loops.sumH;
        int[] sumC = Loops.sumC;
        for (int i = 0; i < used; i++) {
            int r = rows[i], z = own[i] * k + place[r];
            sumG[z] += g[r]; sumH[z] += h[r]; sumC[z]++;
        }
    }
    static void sums(int[] place, int[] rows, int[] own, int used, int k, double[] g, double[] h) {
        for (int i = 0; i < used; i++) {
            int r = rows[i], z = own[i] * k + place[r];
            sumG[z] += g[r]; sumH[z] += h[r]; sumC[z]++;
        }
    }
    static void byValue(int c, int f, int[] rows, int[] own, int used, int m, boolean[] chosen, double[] g, double[] h, double[] gt, double[] ht, int[] ct, int least) {
        double[] v = sorted[c];
        int k = v.length;
        if (m * k > sumC.length) { sumG = new double[m * k]; sumH = new double[m * k]; sumC = new int[m * k]; }
        Arrays.fill(sumG, 0, m * k, 0.0); Arrays.fill(sumH, 0, m * k, 0.0); Arrays.fill(sumC, 0, m * k, 0);
        if (near[c] != null) sums(near[c], rows, own, used, k, g, h);
        else sums(wide[c], rows, own, used, k, g, h);
        for (int a = 0; a < m; a++) if (chosen == null || chosen[a * width + f]) splits(a, f, v, a * k, gt[a], ht[a], ct[a], least);
    }
    static void splits(int a, int f, double[] v, int o, double ga, double ha, int all, int least) {
        double tg = 0, th = 0, whole = score(ga, ha), top = gain[a];
        int tc = 0, won = -1;
        for (int j = 0; j < v.length; j++) {
            int here = sumC[o + j];
            if (here == 0) continue;
            if (won >= 0) { cut[a] = (v[won] + v[j]) / 2; won = -1; }
            tg += sumG[o + j]; th += sumH[o + j]; tc += here;
            if (tc == all) break;
            if (tc < least || all - tc < least) continue;
            if (minWeight != 0 && (th < minWeight || ha - th < minWeight)) continue;
            if (less(tg, th + l2, ga - tg, ha - th + l2, top + whole)) continue;
            double s = score(tg, th) + score(ga - tg, ha - th) - whole;
            if (s > top) { top = s; gain[a] = s; best[a] = f; gl[a] = tg; hl[a] = th; cl[a] = tc; won = j; }
        }
    }

    static void pairs(int[] hr, int[] hc, int hot, int[] node, int m, int[] allowed, boolean[] chosen, boolean random, double[] g, double[] h, double[] gt, double[] ht, int[] ct, int least) {
        int nt = two.length, seen = 0;
        if (m * nt > cellC.length) { cellG = new double[m * nt]; cellH = new double[m * nt]; cellC = new int[m * nt]; }
        if (hot > touched.length) touched = new int[hot];
        for (int i = 0; i < hot; i++) {
            int r = hr[i], at = node[r] * nt + hc[i];
            if (cellC[at]++ == 0) touched[seen++] = at;
            cellG[at] += g[r]; cellH[at] += h[r];
        }
        double[] won = new double[m];
        int[] j = new int[m];
        Arrays.fill(won, Double.NEGATIVE_INFINITY);
        for (int i = 0; i < seen; i++) {
            int at = touched[i], a = at / nt, b = at - a * nt, c = cellC[at];
            double tg = cellG[at], th = cellH[at];
            if (c < least || ct[a] - c < least || allowed[two[b]] == 0) continue;
            if (minWeight != 0 && (th < minWeight || ht[a] - th < minWeight)) continue;
            if (chosen != null && !chosen[a * width + two[b]]) continue;
            double s = score(tg, th) + score(gt[a] - tg, ht[a] - th) - score(gt[a], ht[a]);
            if (s > won[a] || (s == won[a] && b < j[a])) { won[a] = s; j[a] = b; }
        }
        for (int a = 0; a < m; a++) {
            double share = random ? random() : 0.5;
            if (!(won[a] > gain[a])) continue;
            int b = j[a], at = a * nt + b;
            double low = ends[b], high = ends[nt + b];
            gain[a] = won[a]; best[a] = two[b]; cut[a] = low + (high - low) * share;
            gl[a] = gt[a] - cellG[at]; hl[a] = ht[a] - cellH[at]; cl[a] = ct[a] - cellC[at];
        }
        for (int i = 0; i < seen; i++) { int at = touched[i]; cellG[at] = 0; cellH[at] = 0; cellC[at] = 0; }
    }

    static void deal(int[] rows, int used, int[] node, int[] at, int[] to) {
        for (int i = 0; i < used; i++) {
            int r = rows[i], a = node[r];
            if (a >= 0) to[at[a]++] = r;
        }
    }

    static int open(int[] hr, int[] hc, int hot, int[] node) {
        int k = 0;
        for (int i = 0; i < hot; i++) if (node[hr[i]] >= 0) { hr[k] = hr[i]; hc[k++] = hc[i]; }
        return k;
    }

    static int begin(int[] hr, int[] hc, int[] node, int[] allowed) {
        int hot = 0;
        for (int i = 0; i < hotRow.length; i++) if (node[hotRow[i]] >= 0 && allowed[two[hotCol[i]]] != 0) { hr[hot] = hotRow[i]; hc[hot++] = hotCol[i]; }
        return hot;
    }

    static void move(int[] node, int[] child, int m) {
        for (int r = 0; r < n; r++) {
            int a = node[r];
            if (a >= 0) node[r] = best[a] < 0 ? -1 : child[(at(best[a], r) > cut[a] ? m : 0) + a];
        }
    }

    static void choose(boolean[] chosen, int at, int[] usable, double[] drawn, double[] sorted, int cols, int k) {
        for (int c = 0; c < cols; c++) drawn[c] = random();
        System.arraycopy(drawn, 0, sorted, 0, cols);
        Arrays.sort(sorted);
        double most = sorted[k - 1];
        for (int c = 0; c < cols; c++) if (drawn[c] <= most) chosen[at + usable[c]] = true;
    }

    static int leaf(int r) {
        int a = 0;
        while (feature[a] >= 0) a = at(feature[a], r) <= threshold[a] ? left[a] : right[a];
        return a;
    }

    static void grow() throws IOException {
        double[] g = doubles(), h = doubles(), p = doubles();
        int[] allowed = ints(), q = ints();
        long[] state = longs();
        int depths = q[0], least = q[1], enough = q[2], k = q[3], cols = q[4];
        boolean random = q[5] != 0;
        l1 = p[0]; l2 = p[1]; minWeight = p[2];
        double floor = p[3];
        hi = state[0]; lo = state[1]; incHi = state[2]; incLo = state[3];
        feature = new int[64]; left = new int[64]; right = new int[64]; threshold = new double[64]; val = new double[64]; cover = new double[64];
        size = 0;
        add(p[4], p[5]);
        int used = 0;
        int[] node = new int[n], usable = new int[width];
        for (int i = 0; i < n; i++) { node[i] = h[i] > 0 ? 0 : -1; if (h[i] > 0) used++; }
        int u = 0, nm = 0;
        for (int c = 0; c < width; c++) if (allowed[c] != 0) usable[u++] = c;
        int[] place = new int[many.length];
        for (int c = 0; c < many.length; c++) if (allowed[many[c]] != 0) place[nm++] = c;
        int m = used >= enough ? 1 : 0;
        int[] opened = new int[1], ct = new int[] {used}, from = new int[] {0, used};
        double[] gt = new double[] {p[4]}, ht = new double[] {p[5]};
        int[][] rows = new int[nm][], spare = new int[nm][];  // made for the first level that is not counted by values
        boolean dealt = false;
        long places = 0;
        for (int c = 0; c < nm; c++) places += sorted[place[c]].length;
        int[] open = new int[used], own = new int[used];
        int[] hr = null, hc = null;
        int hot = 0;
        if (m > 0) {
            hr = new int[hotRow.length]; hc = new int[hotRow.length];
            hot = begin(hr, hc, node, allowed);
        }
        for (int depth = 0; m > 0 && nm + two.length > 0 && (depths < 0 || depth < depths); depth++) {
            boolean[] chosen = null;
            if (k < cols) {
                chosen = new boolean[m * width];
                double[] drawn = new double[cols], sorted = new double[cols];
                for (int a = 0; a < m; a++) choose(chosen, a * width, usable, drawn, sorted, cols, k);
            }
            gain = new double[m]; cut = new double[m]; gl = new double[m]; hl = new double[m]; best = new int[m]; cl = new int[m];
            Arrays.fill(gain, Double.NEGATIVE_INFINITY);
            Arrays.fill(best, -1);
            sg = 0; sh = 0;
            double[] draws = new double[m];
            boolean counted = !random && from[m] >= MANY && 2 * m * places <= (long) from[m] * nm;
            if (counted) {
                int o = 0;
                for (int r = 0; r < n; r++) if (node[r] >= 0) { own[o] = node[r]; open[o++] = r; }
                for (int c = 0; c < nm; c++) byValue(place[c], many[place[c]], open, own, o, m, chosen, g, h, gt, ht, ct, least);
            } else if (!dealt) {
                for (int c = 0; c < nm; c++) {
                    rows[c] = new int[from[m]]; spare[c] = new int[from[m]];
                    deal(Arrays.copyOfRange(order, place[c] * n, (place[c] + 1) * n), n, node, Arrays.copyOf(from, m), rows[c]);
                }
                dealt = true;
            }
            for (int c = 0; c < nm && !counted; c++) {
                int f = many[place[c]];
                if (random) for (int a = 0; a < m; a++) if (chosen == null || chosen[a * width + f]) draws[a] = random();
                column(f, rows[c], from, m, chosen, random, draws, g, h, gt, ht, ct, least);
            }
            if (two.length > 0) pairs(hr, hc, hot, node, m, allowed, chosen, random, g, h, gt, ht, ct, least);
            int w = 0;
            for (int a = 0; a < m; a++) if (gain[a] > floor) w++;
            if (w == 0) break;
            int[] child = new int[2 * m], counts = new int[2 * w], next = new int[2 * w];
            double[] ng = new double[2 * w], nh = new double[2 * w];
            Arrays.fill(child, -1);
            int first = size, i = 0;
            for (int a = 0; a < m; a++) if (gain[a] > floor) {
                int o = opened[a];
                feature[o] = best[a]; threshold[o] = cut[a]; left[o] = first + i; right[o] = first + w + i;
                ng[i] = gl[a]; nh[i] = hl[a]; counts[i] = cl[a];
                ng[w + i] = gt[a] - gl[a]; nh[w + i] = ht[a] - hl[a]; counts[w + i] = ct[a] - cl[a];
                i++;
            }
            int going = 0;
            for (i = 0; i < 2 * w; i++) { add(ng[i], nh[i]); next[i] = counts[i] >= enough ? going++ : -1; }
            i = 0;
            for (int a = 0; a < m; a++) if (gain[a] > floor) { child[a] = next[i]; child[m + a] = next[w + i]; i++; }
            move(node, child, m);
            opened = new int[going]; gt = new double[going]; ht = new double[going]; ct = new int[going];
            int[] to = new int[going + 1];
            for (i = 0; i < 2 * w; i++) if (next[i] >= 0) {
                int a = next[i];
                opened[a] = first + i; gt[a] = ng[i]; ht[a] = nh[i]; ct[a] = counts[i]; to[a + 1] = to[a] + counts[i];
            }
            if (going > 0 && (depths < 0 || depth + 1 < depths)) {
                for (int c = 0; c < nm && dealt; c++) {
                    deal(rows[c], from[m], node, Arrays.copyOf(to, going), spare[c]);
                    int[] s = rows[c]; rows[c] = spare[c]; spare[c] = s;
                }
                hot = open(hr, hc, hot, node);
            }
            from = to;
            m = going;
        }
        put(feature, size); put(threshold, size); put(left, size); put(right, size); put(val, size); put(cover, size);
        int wanted = q[6] != 0 ? n : 0;
        double[] fitted = new double[wanted];
        for (int r = 0; r < wanted; r++) fitted[r] = val[leaf(r)];
        put(fitted, wanted);
        put(new int[] {(int) (hi >>> 32), (int) hi, (int) (lo >>> 32), (int) lo}, 4);
    }

    static final int BLOCK = 64;
    static short[] rows;  // row by row, each value as its place among the values of its column
    static double[][] values;
    static int rowCount, rowWidth;

    static void setRows() throws IOException {
        int[] q = ints();
        rowCount = q[0]; rowWidth = q[1];
        rows = new short[rowCount * rowWidth];
        values = new double[rowWidth][];
        for (int f = 0; f < rowWidth; f++) {
            double[] c = doubles();
            double low = Double.POSITIVE_INFINITY, high = Double.NEGATIVE_INFINITY;
            for (int i = 0; i < c.length; i++) { double z = c[i] + 0.0; c[i] = z; if (z < low) low = z; if (z > high) high = z; }  // no minus zero
            values[f] = pair(c, low, high) ? new double[] {low, high} : places(c);
            spread(c, f, values[f], low);
        }
    }
    static boolean pair(double[] c, double low, double high) {
        for (int i = 0; i < c.length; i++) if (c[i] != low && c[i] != high) return false;
        return true;
    }
    static double[] places(double[] c) {
        double[] s = Arrays.copyOf(c, c.length);
        Arrays.sort(s);
        int k = 0;
        for (int i = 0; i < s.length; i++) if (i == 0 || s[i] != s[k - 1]) s[k++] = s[i];
        return Arrays.copyOf(s, k);
    }
    static void spread(double[] c, int f, double[] u, double low) {
        if (u.length == 2) for (int i = 0, at = f; i < c.length; i++, at += rowWidth) rows[at] = (short) (c[i] > low ? 1 : 0);
        else for (int i = 0, at = f; i < c.length; i++, at += rowWidth) rows[at] = (short) (upTo(u, c[i]) - 1);
    }
    static int upTo(double[] u, double t) {
        int a = 0, b = u.length;
        while (a < b) { int m = (a + b) >>> 1; if (u[m] <= t) a = m + 1; else b = m; }
        return a;
    }

    // leaves of a block of rows. A node: the left child (the right one follows it), the column, the place that goes left; leaves lead to themselves
    static void walk(long[] node, int o, int depth, int b, int c, int[] at) {
        short[] x = rows;
        int w = rowWidth;
        for (int i = 0; i < c; i++) at[i] = o;
        for (int d = 0; d < depth; d++)
            for (int i = 0, row = b * w; i < c; i++, row += w) {
                long z = node[at[i]];
                at[i] = (int) (z >>> 32) + (((short) z - x[row + ((int) z >>> 16)]) >>> 31);  // the sign: no branch
            }
    }
    // the same for deep trees: rows that are at their leaf are left out
    static int[] going = new int[BLOCK];
    static void walkDeep(long[] node, int o, int b, int c, int[] at) {
        short[] x = rows;
        int w = rowWidth, m = c;
        int[] going = Loops.going;
        for (int i = 0; i < c; i++) { at[i] = o; going[i] = i; }
        while (m > 0) {
            int k = 0;
            for (int j = 0; j < m; j++) {
                int i = going[j], a = at[i];
                long z = node[a];
                int to = (int) (z >>> 32) + (((short) z - x[(b + i) * w + ((int) z >>> 16)]) >>> 31);
                at[i] = to;
                going[k] = i;
                k += (a - to) >>> 31;
            }
            m = k;
        }
    }

    // small methods, for the JVM compiles those soonest
    static void mark(long[] bits, int words, int[] rank, int[] at, int c) {
        for (int i = 0; i < c; i++) { int z = rank[at[i]]; bits[i * words + (z >> 6)] |= 1L << z; }
    }
    static void gather(double[] y, int b, double[] v, double scale, int[] at, int c) {
        for (int i = 0; i < c; i++) y[b + i] += scale * v[at[i]];
    }
    // the nodes of a tree, children side by side; children are numbered after their parents. Returns the depth
    static int lay(int o, int end, int[] f, double[] t, int[] l, int[] r, double[] v, long[] node, int[] place, int[] depth, double[] nv) {
        int free = o + 1, deep = 0;
        place[o] = o;
        for (int i = o; i < end; i++) {
            int p = place[i];
            nv[p] = v[i];
            if (depth[i] > deep) deep = depth[i];
            if (f[i] < 0) { node[p] = ((long) p << 32) | 0x7fffL; continue; }
            place[o + l[i]] = free; place[o + r[i]] = free + 1;
            depth[o + l[i]] = depth[o + r[i]] = depth[i] + 1;
            node[p] = ((long) free << 32) | ((long) f[i] << 16) | ((upTo(values[f[i]], t[i]) - 1) & 0xffffL);
            free += 2;
        }
        return deep;
    }

    static void predict() throws IOException {
        int[] q = ints(), off = ints(), f = ints(), l = ints(), r = ints();
        double[] t = doubles(), v = doubles(), scale = doubles(), base = doubles();
        int trees = off.length - 1, nodes = off[trees];
        int[] place = new int[nodes], depth = new int[nodes], deep = new int[trees];
        double[] nv = new double[nodes];
        long[] node = new long[nodes];
        for (int k = 0; k < trees; k++) deep[k] = lay(off[k], off[k + 1], f, t, l, r, v, node, place, depth, nv);
        double[] y = new double[rowCount];
        int[] at = new int[BLOCK];
        if (q[0] == 0) {
            Arrays.fill(y, base[0]);
            for (int big = 0; big < rowCount; big += 8 * BLOCK)  // rows and tree stay near
                for (int k = 0; k < trees; k++)
                    for (int b = big; b < Math.min(big + 8 * BLOCK, rowCount); b += BLOCK) {
                        int c = Math.min(BLOCK, rowCount - b);
                        if (deep[k] > 8) walkDeep(node, off[k], b, c, at);
                        else walk(node, off[k], deep[k], b, c, at);
                        gather(y, b, nv, scale[k], at, c);
                    }
        } else {
            int[] by = ints(), rank = new int[nodes];
            double[] share = new double[by.length];
            for (int i = 0; i < by.length; i++) {
                int k = Arrays.binarySearch(off, by[i]);
                rank[place[by[i]]] = i; share[i] = scale[k < 0 ? -k - 2 : k];
            }
            int words = (by.length + 63) / 64;
            if (cum.length < trees) { cum = new double[trees]; held = new int[trees]; }
            long[] bits = new long[BLOCK * words];
            for (int b = 0; b < rowCount; b += BLOCK) {
                int c = Math.min(BLOCK, rowCount - b);
                for (int k = 0; k < trees; k++) {
                    if (deep[k] > 8) walkDeep(node, off[k], b, c, at);
                    else walk(node, off[k], deep[k], b, c, at);
                    mark(bits, words, rank, at, c);
                }
                for (int i = 0; i < c; i++) y[b + i] = v[by[median(bits, i * words, words, share)]];
            }
        }
        put(y, rowCount);
    }

    static double[] cum = new double[0];
    static int[] held = new int[0];
    // the leaves of a row lie in order of value and tree
    static int median(long[] bits, int at, int words, double[] share) {
        int c = 0;
        double s = 0;
        double[] cum = Loops.cum;
        int[] held = Loops.held;
        for (int w = 0; w < words; w++) {
            long b = bits[at + w];
            if (b == 0) continue;
            bits[at + w] = 0;
            for (; b != 0; b &= b - 1) {
                int z = w * 64 + Long.numberOfTrailingZeros(b);
                s += share[z];
                held[c] = z;
                cum[c++] = s;
            }
        }
        for (int i = 0; i < c; i++) if (cum[i] >= 0.5 * s) return held[i];
        return held[0];
    }

    static void svr() throws IOException {
        double[] p = doubles(), b = doubles(), g = doubles();
        int n = b.length;
        double[][] k = new double[n][];
        for (int i = 0; i < n; i++) k[i] = doubles();
        double c = p[0], eps = p[1], tol = p[2], gap = 0, up = 0, down = 0;
        for (int s = 0; s < (int) p[3]; s++) {
            int i = 0, j = 0;
            up = Double.POSITIVE_INFINITY; down = Double.NEGATIVE_INFINITY;
            for (int z = 0; z < n; z++) {
                double bz = b[z], gz = g[z];
                if (bz < c) { double u = gz + (bz >= 0 ? eps : -eps); if (u < up) { up = u; i = z; } }
                if (bz > -c) { double d = gz + (bz > 0 ? eps : -eps); if (d > down) { down = d; j = z; } }
            }
            gap = down - up;
            if (gap <= tol) break;
            double t = Math.min(Math.min(gap / Math.max(k[i][i] + k[j][j] - 2 * k[i][j], 1e-12), c - b[i]), b[j] + c);
            if (b[i] < 0) t = Math.min(t, -b[i]);
            if (b[j] > 0) t = Math.min(t, b[j]);
            b[i] += t;
            b[j] -= t;
            step(g, k[i], k[j], t);
        }
        put(b, n);
        put(new double[] {gap, up, down}, 3);
    }
    static void step(double[] g, double[] a, double[] b, double t) {
        for (int z = 0; z < g.length; z++) g[z] += t * (a[z] - b[z]);
    }

    public static void main(String[] args) throws IOException {
        while (true) {
            int op = in.read();
            if (op < 0) return;
            if (op == 1) {
                int[] q = ints();
                n = q[0]; width = q[1];
                MANY = q[2];
                x = doubles(); slot = ints(); codes = ints(); many = ints(); order = ints(); two = ints(); ends = doubles(); hotRow = ints(); hotCol = ints();
                sorted = new double[many.length][]; near = new char[many.length][]; wide = new int[many.length][];
                for (int c = 0; c < many.length; c++) {
                    sorted[c] = doubles();
                    int[] p = ints();
                    if (sorted[c].length > 65536) { wide[c] = p; continue; }
                    near[c] = new char[n];
                    for (int r = 0; r < n; r++) near[c][r] = (char) p[r];
                }
            } else if (op == 2) grow();
            else if (op == 3) setRows();
            else if (op == 4) predict();
            else if (op == 5) svr();
            out.flush();
        }
    }
}
"""


class Loops:
    """The JVM of this process and what it holds."""

    def __init__(self, heap: int = HEAP) -> None:
        import pyspark

        jars = [Path(d) / "jars" for d in (os.environ.get("SPARK_HOME"), Path(pyspark.__file__).parent) if d]
        found = next(j for j in jars if j.is_dir() and [*j.glob("janino-*.jar")])
        home = os.environ.get("JAVA_HOME")
        java = f"{home}/bin/java" if home and Path(home, "bin/java").exists() else shutil.which("java")
        self.pid, self.data, self.rows, self.heap = os.getpid(), None, None, heap
        self.folder = tempfile.TemporaryDirectory(prefix="spindrift-loops-")
        Path(self.folder.name, "Loops.java").write_text(_SOURCE)
        path = ":".join(str(p) for name in ("janino-*.jar", "commons-compiler-*.jar") for p in found.glob(name))
        flags = [f"-Xmx{heap}m", "-XX:+UseSerialGC", "-XX:ActiveProcessorCount=1", "-XX:ReservedCodeCacheSize=32m", "-XX:-UsePerfData"]
        self.jvm = subprocess.Popen(
            [java, *flags, "-cp", path, "org.codehaus.janino.JavaSourceClassLoader", "-sourcepath", self.folder.name, "Loops"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=1 << 16,
        )
        self.call(3, np.zeros(2, np.int32))  # it runs
        if len(self.call(5, np.zeros(4), np.zeros(0), np.zeros(0), answers=(float, float))[1]) != 3:
            raise OSError("no answer")

    def ask(self, op: int, *arrays: np.ndarray, answers: tuple = ()) -> list[np.ndarray] | None:
        """The answers; None if the JVM ended (say, for want of memory). The next use starts another."""
        global _LOOPS
        try:
            return self.call(op, *arrays, answers=answers)
        except (RuntimeError, OSError):
            self.jvm.kill()
            _LOOPS = None
            return None

    def call(self, op: int, *arrays: np.ndarray, answers: tuple = ()) -> list[np.ndarray]:
        to, get = self.jvm.stdin, self.jvm.stdout
        to.write(bytes([op]))
        for a in arrays:
            to.write(struct.pack("<i", a.size * a.itemsize // (8 if a.dtype == float else 4)))
            to.write(np.ascontiguousarray(a).ravel().data.cast("B") if a.size else b"")
        to.flush()
        out = []
        for kind in answers:
            head = get.read(4)
            if len(head) < 4:
                raise RuntimeError("the JVM of the model loops ended")
            n = struct.unpack("<i", head)[0]
            out.append(np.frombuffer(bytearray(get.read(n * np.dtype(kind).itemsize)), dtype=kind))
        return out


_LOOPS: Loops | bool | None = None


def loops(heap: int = HEAP) -> Loops | None:
    """The JVM of this process, with a heap of so many MB at least; None if there is none to be had."""
    global _LOOPS
    if os.environ.get("SPINDRIFT_NATIVE") == "0":
        return None
    if _LOOPS and _LOOPS.pid == os.getpid() and _LOOPS.heap < heap:
        _LOOPS.jvm.kill()
        _LOOPS.jvm.wait()
        _LOOPS = None
    if _LOOPS is None or (_LOOPS and _LOOPS.pid != os.getpid()):
        try:
            _LOOPS = Loops(heap)
        except (OSError, RuntimeError, StopIteration, TypeError, ImportError):
            _LOOPS = False
    return _LOOPS or None


def release(most: int = 32 << 20) -> None:
    """Ends the JVM of this process if it holds more than so many bytes of columns; the next use starts another."""
    global _LOOPS
    if _LOOPS and _LOOPS.pid == os.getpid() and _LOOPS.data is not None and 12 * len(_LOOPS.data.many) * len(_LOOPS.data.x) > most:
        _LOOPS.jvm.kill()
        _LOOPS.jvm.wait()
        _LOOPS = None


def heap_of(data) -> int:
    """MB that growing trees on these columns takes: twice the rows in sorted lists, once in all else."""
    n, many = data.x.shape[0], len(data.many)
    each = 8 * data.x.dense.shape[1] + 4 * len(data.x.codes) + 18 * many + 64
    return max(HEAP, int((n * each + 16 * len(data.hot[0])) * 1.5 / (1 << 20)) + 64)


def grow(data, g: np.ndarray, h: np.ndarray, allowed: np.ndarray, p, least: int, enough: int, k: int, n_cols: int, floor: float, rng: np.random.Generator, fitted: bool = True) -> list[np.ndarray] | None:
    """feature, threshold, left, right, value, cover of the tree and, if wanted, its value for every row; None if it was not grown."""
    drawn = rng.bit_generator.state
    if drawn["bit_generator"] != "PCG64" or not len(g) or (need := heap_of(data)) > MOST_HEAP or (c := loops(need)) is None:
        return None
    if c.data is not data:
        from spindrift.models.trees import MANY_ROWS

        shape, parts = np.array([*data.x.shape, MANY_ROWS], np.int32), [a for v, p in zip(data.values, data.place) for a in (v, p.astype(np.int32))]
        made = c.ask(1, shape, data.x.dense.T, *(np.asarray(a, np.int32) for a in (data.x.slot, data.x.codes, data.many, data.order, data.two)), data.ends, *(np.asarray(a, np.int32) for a in data.hot), *parts)
        if made is None:
            return None
        c.data = data
    s, low = drawn["state"], (1 << 64) - 1
    state = np.array([s["state"] >> 64, s["state"] & low, s["inc"] >> 64, s["inc"] & low], np.uint64)
    made = c.ask(
        2, g, h, np.array([p.l1, p.l2, p.min_weight, floor, g.sum(), h.sum()]), allowed.astype(np.int32), np.array([-1 if p.max_depth is None else p.max_depth, least, enough, k, n_cols, p.random_cuts, fitted], np.int32), state,
        answers=(np.int32, float, np.int32, np.int32, float, float, float, np.uint32),
    )
    if made is None:
        return None
    *out, after = made
    if p.random_cuts or k < n_cols:
        rng.bit_generator.state = drawn | {"state": s | {"state": sum(int(v) << (96 - 32 * i) for i, v in enumerate(after))}}
    return out


def predict(model: dict, x: np.ndarray) -> np.ndarray | None:
    """Values of a model of trees; None if they were not made."""
    c = loops()
    if c is None or not len(x) or len(model["feature"]) > NODES or x.shape[1] >= WIDE or c.rows is not x and not np.isfinite(x).all():
        return None
    if (x.nbytes > BLOCK_BYTES or len(x) > BLOCK) and len(x) > 1:
        half = len(x) // 2
        parts = [predict(model, np.asfortranarray(x[:half])), predict(model, np.asfortranarray(x[half:]))]
        return None if any(p is None for p in parts) else np.concatenate(parts)
    if c.rows is not x:
        if c.ask(3, np.array(x.shape, np.int32), *np.asfortranarray(x, dtype=float).T) is None:
            return None
        c.rows = x
    v, mid = np.asarray(model["value"], float), model["kind"] == "median"
    leaf = np.nonzero(np.asarray(model["feature"]) < 0)[0]
    arrays = [np.array([int(mid)], np.int32), *(np.asarray(model[k], np.int32) for k in ("offset", "feature", "left", "right"))]
    arrays += [np.asarray(model["threshold"], float), v, np.asarray(model["scale"], float), np.array([float(model["base"])])]
    made = c.ask(4, *arrays, *([leaf[np.argsort(v[leaf], kind="stable")].astype(np.int32)] if mid else []), answers=(float,))
    return None if made is None else made[0]


def svr(k: np.ndarray, c: float, eps: float, tol: float, most: int, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, float, float, float] | None:
    """(coefficients, violation left, smallest upper bound, largest lower bound); None if they were not made."""
    j = loops()
    if j is None or not len(b) or k.nbytes > KERNEL:
        return None
    made = j.ask(5, np.array([c, eps, tol, most]), b, g, *k, answers=(float, float))
    return None if made is None else (made[0], *map(float, made[1]))
